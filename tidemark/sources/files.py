"""Readers, ingest checks and writers for prices, macro series, positioning
files, signals, trades, snapshots and receipts.

Readers take explicit schemas, so no inference pass over the files is needed.
Checks return tables of offending rows, empty when the data are sound; the
``load_*`` functions raise on them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import lookup

OHLCV = ("open", "high", "low", "close", "volume")

SIGNAL_SCHEMA = """date DATE, feature_date DATE, horizon INT, model_name STRING, model_trained_on DATE,
 reconstructed BOOLEAN, rankings ARRAY<STRUCT<rank: INT, ticker: STRING, mt5: STRING, position: STRING,
 predicted_return: DOUBLE, recent_mom_5d: DOUBLE, current_vol: DOUBLE, name: STRING>>,
 confidence STRUCT<backtest_sharpe: DOUBLE, backtest_cs_ric: DOUBLE, days_since_retrain: INT,
  current_vol_regime: STRING, vol_scale: DOUBLE>"""
SNAPSHOT_SCHEMA = """account STRING, doc BIGINT, positions ARRAY<STRUCT<position_id: STRING, symbol: STRING,
 type: STRING, volume: DOUBLE, openPrice: DOUBLE, profit: DOUBLE>>"""
RECEIPT_SCHEMA = """executed_at TIMESTAMP, signal_date DATE, status STRING, book_before MAP<STRING, STRING>,
 planned_closes ARRAY<STRING>, planned_opens ARRAY<ARRAY<STRING>>, book_after_verified MAP<STRING, STRING>"""
#: Columns of a trade file, and what older files call two of them.
TRADE_COLUMNS = ("open_time", "symbol", "side", "volume", "open_price", "close_time", "close_price",
                 "profit", "note")
TRADE_ALIASES = {"open_date": "open_time", "close_date": "close_time"}


# ── prices ──────────────────────────────────────────────────────────────────
def write_prices(bars: DataFrame, path: str) -> None:
    """Sorted by asset and date, so a reader of few assets or a date range skips
    whole row groups; no directory per asset, which a wide universe could not bear."""
    (bars.repartitionByRange("asset", "date").sortWithinPartitions("asset", "date")
     .write.mode("overwrite").parquet(path))


def read_prices(spark: SparkSession, path: str, assets: Sequence[str] | None = None,
                start: str | None = None, end: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if assets is not None:
        df = df.where(F.col("asset").isin(list(assets)))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def normalise_prices(raw: DataFrame) -> DataFrame:
    """Five columns in order, absent ones null, dates floored to the day."""
    names = {c.lower(): c for c in raw.columns}
    cols = [F.col(names[c]).cast("double").alias(c) if c in names
            else F.lit(None).cast("double").alias(c) for c in OHLCV]
    return raw.select("asset", F.to_date(names.get("date", "date")).alias("date"), *cols)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def price_quality(prices: DataFrame) -> DataFrame:
    return prices.groupBy("asset").agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in OHLCV],
        F.count_if(F.col("close") <= 0).alias("non_positive"))


def summary(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Rows, first and last date per series; with ``value`` also its non-nulls."""
    extra = [] if value is None else [F.count(value).alias("n_values")]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                               F.max("date").alias("last_date"), *extra)


def absent(spark: SparkSession, wanted: Sequence[str], df: DataFrame, key: str) -> DataFrame:
    want = spark.createDataFrame([(w,) for w in wanted], f"{key} string")
    return want.join(df.select(key).distinct(), key, "left_anti")


def load_all(spark: SparkSession, wanted: Sequence[str], df: DataFrame, key: str) -> DataFrame:
    """The wanted series; one missing series fails the load, none is dropped."""
    gone = [r[0] for r in absent(spark, wanted, df, key).collect()]
    if gone:
        raise ValueError(f"no data for {key}: {', '.join(sorted(gone))}")
    return df.where(F.col(key).isin(list(wanted)))


# ── macro ───────────────────────────────────────────────────────────────────
def normalise_macro(raw: DataFrame) -> DataFrame:
    return raw.select("series_id", F.to_date("date").alias("date"),
                      F.col("value").cast("double").alias("value"))


def macro_gaps(macro: DataFrame, max_days: int = 7) -> DataFrame:
    """Per series: gaps of more than ``max_days`` between values, the longest and
    the day it ended. Nulls are no observations."""
    w = Window.partitionBy("series_id").orderBy("date")
    v = macro.where(F.col("value").isNotNull())
    gap = v.withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    wide = F.col("gap") > max_days
    return gap.groupBy("series_id").agg(
        F.count_if(wide).alias("n_gaps"), F.max(F.when(wide, F.col("gap"))).alias("longest"),
        F.max(F.when(wide, F.struct("gap", "date")))["date"].alias("longest_end"))


# ── positioning files ───────────────────────────────────────────────────────
# Column names of the public positioning files.
CODE, NAME = "CFTC_Contract_Market_Code", "Market_and_Exchange_Names"
DATE_NEW, DATE_OLD = "Report_Date_as_YYYY-MM-DD", "Report_Date_as_MM_DD_YYYY"
NUMERIC = {
    "mm_long": "M_Money_Positions_Long_All",
    "mm_short": "M_Money_Positions_Short_All",
    "prod_long": "Prod_Merc_Positions_Long_All",
    "prod_short": "Prod_Merc_Positions_Short_All",
    "oi": "Open_Interest_All",
}


def read_yearly(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of yearly files whose columns drift; ``source_no`` keeps their order."""
    out = None
    for i, p in enumerate(paths):
        df = spark.read.parquet(p).withColumn("source_no", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no yearly files given")
    return out


def report_date(columns: Sequence[str]) -> Column:
    """The report date under any of its names; of other columns the first that
    is named for a date and not for a packed or as-of one."""
    def fits(c: str) -> bool:
        low = c.lower()
        return "date" in low and not any(part in low for part in ("yymmdd", "as_of"))
    names = [c for c in (DATE_NEW, DATE_OLD) if c in columns] or [c for c in columns if fits(c)][:1]
    if not names:
        raise ValueError("a positioning file needs a column for its report date")
    return F.coalesce(*[F.try_to_date(F.col(f"`{c}`").cast("string"), pattern)
                        for c in names for pattern in ("yyyy-MM-dd", "MM/dd/yyyy")])


def slim_positioning(raw: DataFrame) -> DataFrame:
    """Eight columns; text that is no number becomes null."""
    nums = [F.col(src).cast("string").try_cast("double").alias(c) for c, src in NUMERIC.items()]
    return raw.select(F.trim(F.col(CODE).cast("string")).alias("code"),
                      F.upper(F.col(NAME).cast("string")).alias("name"),
                      report_date(raw.columns).alias("report_date"), "source_no", *nums)


def extract_assets(slim: DataFrame, codes: dict[str, str], keywords: dict[str, str]) -> DataFrame:
    """Rows of each asset by code; an asset whose code never occurs is found by a
    keyword in the market name. Released three days after the report."""
    def tagged(rule: dict[str, str], hit: Callable[[Column], Column]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(k).alias("k"))
                          for a, k in rule.items()])
        return slim.withColumn("m", F.explode(F.filter(items, lambda x: hit(x["k"])))).select(
            F.col("m.asset").alias("asset"), "*").drop("m")
    by_code = tagged({a: c.strip() for a, c in codes.items()}, lambda k: F.col("code") == k)
    by_name = tagged(keywords, lambda k: F.contains(F.col("name"), k))
    by_name = by_name.join(by_code.select("asset").distinct(), "asset", "left_anti")
    return by_code.unionByName(by_name).withColumn("release_date", F.date_add("report_date", 3))


def last_per_release(rows: DataFrame, start: str, end: str) -> DataFrame:
    """One row per asset and release date, the later file's; range inclusive."""
    cols = list(NUMERIC)
    best = rows.groupBy("asset", "release_date").agg(
        F.max(F.struct("source_no", "report_date", *cols)).alias("r"))
    return best.select("asset", "release_date", "r.report_date", *[f"r.{c}" for c in cols]).where(
        F.col("release_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def positioning_coverage(cot: DataFrame, start: str, end: str) -> DataFrame:
    expected = (int(end[:4]) - int(start[:4]) + 1) * 52
    return cot.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.min("release_date").alias("first_release"),
        F.max("release_date").alias("last_release"),
        (F.count(F.lit(1)) * 100.0 / expected).alias("pct"))


# ── documents ───────────────────────────────────────────────────────────────
def read_documents(spark: SparkSession, path: str, schema: str, pretty: bool = False) -> DataFrame:
    """JSON documents, one per line or (``pretty``) one per file."""
    return spark.read.schema(schema).json(path, multiLine=pretty)


def exists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    return None if missing(spark, path) else spark.read.format(fmt).load(path)


def read_signals(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    return read_documents(spark, path, SIGNAL_SCHEMA, pretty).orderBy("date")


def signal_digits(signals: DataFrame) -> DataFrame:
    """A stored signal has 6 digits for returns, 4 for volatility and 3 for the
    scale; numbers that are not finite become null."""
    def finite(c: Column, digits: int) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits))
    kinds = signals.schema["rankings"].dataType.elementType.names
    digits = {"predicted_return": 6, "recent_mom_5d": 6, "current_vol": 4}

    def item(r: Column) -> Column:
        for name in digits:
            if name in kinds:
                r = r.withField(name, finite(r[name], digits[name]))
        return r
    out = signals.withColumn("rankings", F.transform("rankings", item))
    if "confidence" in signals.columns:
        conf = F.col("confidence")
        for name, n in (("vol_scale", 3), ("backtest_sharpe", 12), ("backtest_cs_ric", 12)):
            if name in signals.schema["confidence"].dataType.names:
                conf = conf.withField(name, finite(F.col("confidence")[name], n))
        out = out.withColumn("confidence", conf)
    return out


def missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing is stored under ``path`` yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_signals(signals: DataFrame, path: str) -> None:
    """Append signals whose date is not stored yet: the first document of a date
    stays, in the store and within a batch (there the earliest feature date, then
    the first by its content)."""
    spark = signals.sparkSession
    if not missing(spark, path):
        old = read_documents(spark, path, SIGNAL_SCHEMA).select("date").distinct()
        signals = signals.join(old, "date", "left_anti")
    one = Window.partitionBy("date").orderBy("feature_date", F.to_json(F.struct("rankings")))
    signals = signals.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    signal_digits(signals).write.mode("append").json(path, ignoreNullFields=False)


def write_trades(trades: DataFrame, path: str) -> None:
    """One folder of files per account, with times of day and both prices."""
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("open_time", "close_time")}
    (trades.select("account", *TRADE_COLUMNS).withColumns(times)
     .write.mode("overwrite").partitionBy("account").csv(path, header=True, emptyValue=""))


def trade_time(c: str) -> Column:
    """A time, or a day at midnight."""
    text = F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


#: Distinct headers that the trade files of one path may have.
MOST_HEADERS = 200
#: Files whose headers are broadcast, and rows of accounts, at most.
HEADS = 50_000


def read_trades(spark: SparkSession, path: str, accounts: DataFrame | None = None,
                file_pattern: str | None = None) -> DataFrame:
    """Trade files: '#' lines skipped, symbols upper-cased, empty fields null,
    account from the folder or (``file_pattern``) from the file name, trades
    before an account's ``active_from`` dropped.

    Each file is read by its own header: lines come with their file, the first that is
    no comment is its header, and lines are parsed once for each distinct header.
    Columns are bound by name; absent ones are null, unknown ones an error. A quoted
    field must not hold a line break."""
    lines = (spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
             .withColumn("start", F.col("_metadata.file_block_start")).withColumn("at", F.monotonically_increasing_id()))
    lines = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    # a file's first part is read by one task in order, so its header has the least number there
    # the lines are not shuffled to meet them, since a file may hold any share of all lines
    heads = lookup(lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")), "heads", HEADS)
    layouts = [r["header"] for r in heads.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(layouts) > MOST_HEADERS:
        raise ValueError(f"trade files with more than {MOST_HEADERS} distinct headers")

    def decoded(c: Column) -> Column:
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = decoded(decoded(F.regexp_extract("file", "account=([^/]+)/", 1)))      # of the folder's name, then of the path
    account = F.regexp_extract(decoded(F.col("file")), file_pattern, 1) if file_pattern else folder
    bodies = lines.join(heads, "file").where(F.col("value") != F.col("header")).withColumn("account", account)
    df = None
    for header in sorted(layouts):
        names = [c.strip().strip('"').lower() for c in header.split(",")]
        bound = {TRADE_ALIASES.get(c, c): i for i, c in enumerate(names) if file_pattern or c != "account"}
        unknown = sorted(set(bound) - set(TRADE_COLUMNS))
        lacking = sorted({"open_time", "symbol", "side"} - set(bound))
        if unknown or lacking:
            raise ValueError(f"trade file with unknown columns {unknown}, without {lacking}")
        fields = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(len(names))))
        part = bodies.where(F.col("header") == header).withColumn("_f", fields).select("account", *[
            (F.col(f"_f.c{bound[c]}") if c in bound else F.lit(None).cast("string")).alias(c) for c in TRADE_COLUMNS])
        df = part if df is None else df.unionByName(part)
    if df is None:
        df = bodies.select("account", *[F.lit(None).cast("string").alias(c) for c in TRADE_COLUMNS])

    def number(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit("")).try_cast("double").alias(c)
    df = df.select("account", F.upper("symbol").alias("symbol"), "side", number("volume"),
                   trade_time("open_time").alias("open_time"), trade_time("close_time").alias("close_time"),
                   number("open_price"), number("close_price"), number("profit"),
                   F.coalesce("note", F.lit("")).alias("note"))
    df = df.withColumns({"open_date": F.col("open_time").cast("date"), "close_date": F.col("close_time").cast("date")})
    if accounts is None:
        return df
    a = lookup(accounts.select("account", "active_from"), "accounts", HEADS)
    return df.join(a, "account", "left").where(
        F.col("active_from").isNull() | (F.col("open_date") >= F.col("active_from"))).drop("active_from")


def receipts(plan: DataFrame, before: DataFrame, executed_at: dt.datetime) -> DataFrame:
    """One receipt per signal date from planned orders and the book before; the
    collected parts are one universe each."""
    def of(action: str, item: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("action") == action, item)))
    p = plan.groupBy("date").agg(
        of("close", F.col("symbol")).alias("planned_closes"),
        of("open", F.array("symbol", "side")).alias("planned_opens"))
    b = before.groupBy("date").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("symbol", "side")))).alias("book_before"))
    return p.join(b, "date", "full").select(
        F.lit(executed_at).cast("timestamp").alias("executed_at"), F.col("date").alias("signal_date"),
        F.lit("OK").alias("status"), "book_before", "planned_closes", "planned_opens")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def newest_folder(spark: SparkSession, path: str, column: str) -> str:
    """The folder ``column=value`` with the greatest value, from the listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(f"{column}=")]
    if not names:
        raise FileNotFoundError(f"no {column} folder under {path}")
    return f"{path}/{max(names)}"


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Closes of the newest ``snapshot_date`` folder; no other folder is in the scan.
    Folder names are ISO dates, so their order as text is that of the dates."""
    newest = newest_folder(spark, path, "snapshot_date")
    return spark.read.option("basePath", path).parquet(newest).where(F.col("close").isNotNull())


# ── keyed stores ────────────────────────────────────────────────────────────
def fingerprint(**fields) -> str:
    """Sixteen hexadecimal digits of the fields, sorted by name."""
    return hashlib.md5(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _entry(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    path = f"{root}/manifest/{key}"
    return None if missing(spark, f"{path}/_SUCCESS") else spark.read.schema(MANIFEST).json(path)


MANIFEST = "key string, path string, fields string"


def _enter(spark: SparkSession, root: str, key: str, path: str, fields: dict) -> None:
    row = [(key, path, json.dumps(fields, sort_keys=True, default=str))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/{key}")


def keyed_matrix(spark: SparkSession, root: str, build: Callable[[], DataFrame], ticker: str, start: dt.date,
                 end: dt.date, force: bool = False, **fields) -> DataFrame:
    """The feature matrix stored for (ticker, start, end) and further fields, built
    first if there is none. Data go to a folder of their own; the manifest entry that
    names it is written last. A broken write leaves no entry and is never read, and a
    forced rebuild leaves readers of the earlier folder alone."""
    fields = {"ticker": ticker, "start": start, "end": end, **fields}
    key = fingerprint(**fields)
    entry = None if force else _entry(spark, root, key)
    if entry is None:
        path = f"{root}/data/{key}-{uuid.uuid4().hex[:12]}"
        build().write.parquet(path)
        _enter(spark, root, key, path, fields)
        return spark.read.parquet(path)
    return spark.read.parquet(entry.first()["path"])


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame],
           force: bool = False) -> DataFrame:
    """Read a stored feature matrix, building and storing it first if needed. A
    folder without its commit marker is a broken write and is built anew."""
    if force or missing(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_history(accounts: DataFrame, trades: DataFrame) -> DataFrame:
    return accounts.select("account").join(trades.select("account").distinct(), "account", "left_anti")


# ── model registry ──────────────────────────────────────────────────────────
def register_model(model, root: str, name: str, trained_at: dt.date, features: Sequence[str],
                   spark: SparkSession) -> str:
    """Store a model and enter it under its name and day. The entry is written last
    and replaces an earlier one of that name and day, so a retry registers once and a
    broken write is not seen."""
    path = f"{root}/models/{name}-{trained_at.isoformat()}-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    key = fingerprint(name=name, trained_at=trained_at)
    spark.createDataFrame([(name, trained_at, path, list(features))], REGISTRY).coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/registry/entry={key}")
    return path


REGISTRY = "name string, trained_at date, path string, features array<string>"


def latest_model(spark: SparkSession, root: str, name: str) -> DataFrame:
    r = spark.read.schema(REGISTRY).parquet(f"{root}/registry").where(F.col("name") == name)
    return r.agg(F.max(F.struct("trained_at", "path", "features")).alias("m")).select("m.*")


def is_stale(latest: DataFrame, today: dt.date, max_age_days: int = 7) -> DataFrame:
    age = F.datediff(F.lit(today), "trained_at")
    return latest.withColumn("age_days", age).withColumn("stale", F.col("age_days") >= max_age_days)
