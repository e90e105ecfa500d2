"""Queries of readers, ingest checks and sinks. Files are written from the given
tables into the shared scratch folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog import ledger as cl
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.functions.cluster import scratch_path
from tidemark.functions.expr import rounded
from tidemark.operators import ledger as lg
from tidemark.operators import timeseries as ts
from tidemark.sources import files as fs
from tidemark.sources import tables as tb


@query("s01_read_prices", with_("bars", f"""
SELECT asset, date, {rnd('open high low close volume', 9)} FROM bars WHERE asset IN ('ASIA', 'EUROPE')
  AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""))
def _(s, d):
    path = scratch_path(s, "prices")
    fs.write_prices(tb.daily_bars(s, d), path)
    return rounded(fs.read_prices(s, path, ["ASIA", "EUROPE"], "1997-01-01", "1998-12-31"), 9)


@query("s02_normalise_prices", """
SELECT event_type AS asset, CAST(ts AS DATE) AS date, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high,
  CAST(NULL AS DOUBLE) AS low, value AS close, CAST(user_id AS DOUBLE) AS volume FROM events""")
def _(s, d):
    raw = tb.table(s, d, "events").select(F.col("event_type").alias("asset"), F.col("ts").alias("Date"),
                                          F.col("value").alias("Close"), F.col("user_id").alias("Volume"))
    return fs.normalise_prices(raw)


@query("s03_duplicates", """
SELECT event_type AS asset, date_trunc('minute', ts) AS date, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s, d):
    ev = tb.table(s, d, "events").select(F.col("event_type").alias("asset"),
                                         F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("date"))
    return fs.duplicates(ev, "asset", "date")


@query("s04_price_quality", with_("bars", """
SELECT asset, count(CASE WHEN open IS NULL THEN 1 END) AS null_open, count(CASE WHEN high IS NULL THEN 1 END) AS null_high,
  count(CASE WHEN low IS NULL THEN 1 END) AS null_low, count(CASE WHEN close < 500 THEN 1 END) AS null_close,
  count(CASE WHEN volume IS NULL THEN 1 END) AS null_volume, count(CASE WHEN close >= 500 AND close <= 1500 THEN 1 END) AS non_positive
FROM bars GROUP BY 1"""))
def _(s, d):
    p = tb.daily_bars(s, d).withColumn("close", F.when(F.col("close") >= 500, F.col("close") - 1500))
    return fs.price_quality(p)


@query("s05_missing_assets", with_("bars", """
SELECT n_name AS asset FROM nation WHERE n_name NOT IN (SELECT asset FROM bars)
UNION SELECT r_name FROM region WHERE r_name NOT IN (SELECT asset FROM bars)"""))
def _(s, d):
    names = [r[0] for t, c in (("nation", "n_name"), ("region", "r_name"))
             for r in tb.table(s, d, t).select(c).collect()]      # configured universe: 30 names
    return fs.absent(s, names, ct.bars(s, d), "asset")


@query("s05_load_all", with_("bars", f"""
SELECT asset, date, {rnd('close', 9)} FROM bars WHERE asset IN {ct.BASKET}"""))
def _(s, d):
    return rounded(fs.load_all(s, ct.BASKET, ct.bars(s, d), "asset"), 9)


@query("s06_summary", with_("bars", """
SELECT asset, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1"""))
def _(s, d):
    return fs.summary(ct.bars(s, d), "asset")


@query("s07_read_macro", with_("macro", f"SELECT series_id, date, {rnd('value', 7)} FROM macro"))
def _(s, d):
    path = scratch_path(s, "macro")
    tb.macro_series(s, d).write.parquet(path)
    return rounded(fs.normalise_macro(s.read.parquet(path)), 7)


@query("s08_normalise_macro", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s, d):
    raw = tb.table(s, d, "orders").select(F.col("o_orderpriority").alias("series_id"),
                                          F.col("o_orderdate").alias("date"),
                                          F.col("o_totalprice").alias("value"))
    return fs.duplicates(fs.normalise_macro(raw), "series_id", "date")


@query("s09_macro_gaps", with_("macro", """
SELECT series_id, count(CASE WHEN gap > 7 THEN 1 END) AS n_gaps, CAST(max(CASE WHEN gap > 7 THEN gap END) AS INTEGER) AS longest,
  max(CASE WHEN gap > 7 THEN struct_pack(g := gap, d := date) END).d AS longest_end
FROM (SELECT *, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap FROM macro WHERE value IS NOT NULL) GROUP BY 1"""))
def _(s, d):
    return fs.macro_gaps(tb.macro_series(s, d))


@query("s10_macro_summary", with_("macro", """
SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(value) AS n_values
FROM macro GROUP BY 1"""))
def _(s, d):
    m = tb.macro_series(s, d)
    ids = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return fs.summary(fs.load_all(s, ids, m, "series_id"), "series_id", "value")


# ── positioning files ───────────────────────────────────────────────────────
CODES = {"AFRICA": "C-AFRICA", "AMERICA": "C-AMERICA", "ASIA": "no such code", "EUROPE": "C-EUROPE",
         "MIDDLE EAST": "C-MIDDLE EAST"}
KEYWORDS = {"ASIA": "ASIA", "EUROPE": "EUROPE"}


def yearly_files(s, d):
    """Two files with different date columns; 1998 is in both, with other figures
    in the first, and a dot stands for zero in one numeric column."""
    cot = tb.positioning(s, d)
    def out(df, date_col, fmt, bump):
        nums = [F.when(F.col(c) == 0, ".").otherwise((F.col(c) + bump).cast("string")).alias(src)
                for c, src in fs.NUMERIC.items()]
        path = scratch_path(s, "positioning")
        df.select(F.concat(F.lit("  C-"), "asset", F.lit(" ")).alias(fs.CODE),
                  F.concat(F.lower("asset"), F.lit(" - exchange")).alias(fs.NAME),
                  F.date_format("report_date", fmt).alias(date_col), *nums).write.parquet(path)
        return path
    y = F.year("report_date")
    return [out(cot.where(y <= 1998), fs.DATE_OLD, "MM/dd/yyyy", 1.0),
            out(cot.where(y >= 1998), fs.DATE_NEW, "yyyy-MM-dd", 0.0)]


def _num(c: str, bump: str) -> str:
    return f"CASE WHEN {c} <> 0 THEN {c} + {bump} END AS {c}"


cte("cot_raw", " UNION ALL ".join(
    f"SELECT asset, report_date, {no} AS source_no, {', '.join(_num(c, b) for c in fs.NUMERIC)} FROM cot WHERE {w}"
    for no, b, w in ((0, "1.0", "year(report_date) <= 1998"), (1, "0.0", "year(report_date) >= 1998"))), "cot")
NUMS = " ".join(fs.NUMERIC)


@query("s11_read_yearly", with_("cot_raw", "SELECT source_no, count(*) AS n_rows FROM cot_raw GROUP BY 1"))
def _(s, d):
    return fs.read_yearly(s, yearly_files(s, d)).groupBy("source_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s12_report_date", with_("cot_raw", """
SELECT report_date, source_no, count(*) AS n_rows FROM cot_raw GROUP BY 1, 2"""))
def _(s, d):
    slim = fs.slim_positioning(fs.read_yearly(s, yearly_files(s, d)))
    return slim.groupBy("report_date", "source_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s13_slim_columns", with_("cot_raw", f"""
SELECT 'C-' || asset AS code, upper(asset) || ' - EXCHANGE' AS name, report_date, source_no, {rnd(NUMS, 4)} FROM cot_raw"""))
def _(s, d):
    return rounded(fs.slim_positioning(fs.read_yearly(s, yearly_files(s, d))), 4)


def extracted(s, d):
    return fs.extract_assets(fs.slim_positioning(fs.read_yearly(s, yearly_files(s, d))), CODES, KEYWORDS)


@query("s14_extract_assets", with_("cot_raw", f"""
SELECT asset, report_date, source_no, {rnd('mm_long oi', 4)} FROM cot_raw"""))
def _(s, d):
    return rounded(extracted(s, d), 4, "asset", "report_date", "source_no", "mm_long", "oi")


@query("s15_release_date", with_("cot_raw", """
SELECT asset, report_date, report_date + 3 AS release_date, count(*) AS n FROM cot_raw GROUP BY 1, 2"""))
def _(s, d):
    return extracted(s, d).groupBy("asset", "report_date", "release_date").agg(F.count(F.lit(1)).alias("n"))


@query("s16_last_per_release", with_("cot_raw", f"""
SELECT asset, report_date + 3 AS release_date, report_date, {rnd(NUMS, 4)} FROM cot_raw
WHERE report_date + 3 BETWEEN DATE '1996-01-05' AND DATE '2000-12-29'
QUALIFY row_number() OVER (PARTITION BY asset, report_date ORDER BY source_no DESC) = 1"""))
def _(s, d):
    return rounded(fs.last_per_release(extracted(s, d), "1996-01-05", "2000-12-29"), 4)


@query("s17_positioning_coverage", with_("cot", """
SELECT asset, count(*) AS n_weeks, min(release_date) AS first_release, max(release_date) AS last_release,
  round(count(*) * 100.0 / (7 * 52), 6) + 0.0 AS pct FROM cot GROUP BY 1"""))
def _(s, d):
    return rounded(fs.positioning_coverage(tb.positioning(s, d), "1995-01-01", "2001-12-31"), 6)


# ── documents ───────────────────────────────────────────────────────────────
SIG_COLS = """SELECT date, feature_date, reconstructed, asset AS ticker, CAST(rank AS INTEGER) AS rank, position,
  round(pred, 6) + 0.0 AS predicted_return FROM sig_pos"""


def unnest_signals(df):
    return df.select("date", "feature_date", "reconstructed", F.explode("rankings").alias("r")).select(
        "date", "feature_date", "reconstructed", "r.ticker", "r.rank", "r.position",
        (F.col("r.predicted_return") + F.lit(0.0)).alias("predicted_return"))


@query("s18_read_signals", with_("sig_pos", SIG_COLS))
def _(s, d):
    path = scratch_path(s, "signals")
    fs.write_signals(cl.signals(s, d), path)
    return unnest_signals(fs.read_signals(s, path))


FULL_COLS = """SELECT date, asset AS ticker, CAST(rank AS INTEGER) AS rank, round(pred, 6) + 0.0 AS predicted_return,
  CASE WHEN rank <> 1 THEN round(round(pred, 6) * 2 / 3, 6) + 0.0 END AS recent_mom_5d, round(abs(round(pred, 6)) / 3, 4) + 0.0 AS current_vol,
  'asset ' || asset AS name, DATE '1997-12-31' AS model_trained_on, 12 AS days_since_retrain, 'low' AS current_vol_regime,
  CAST(0.667 AS DOUBLE) AS vol_scale, CAST(NULL AS DOUBLE) AS backtest_sharpe FROM sig_pos"""


@query("s19_full_documents", with_("sig_pos", FULL_COLS))
def _(s, d):
    """All fields, numbers that are not finite, and every document twice in the batch."""
    def item(r):
        p = r["predicted_return"]
        return F.struct(r["rank"], r["ticker"], r["mt5"], r["position"], p.alias("predicted_return"),
                        F.when(r["rank"] == 1, F.lit(float("inf"))).otherwise(p * 2 / 3).alias("recent_mom_5d"),
                        (F.abs(p) / 3).alias("current_vol"), F.concat(F.lit("asset "), r["ticker"]).alias("name"))
    conf = F.struct(F.lit(float("nan")).alias("backtest_sharpe"), F.lit(0.05).alias("backtest_cs_ric"),
                    F.lit(12).alias("days_since_retrain"), F.lit("low").alias("current_vol_regime"),
                    F.lit(2 / 3).alias("vol_scale"))
    sig = cl.signals(s, d).withColumns({"rankings": F.transform("rankings", item), "confidence": conf,
                                         "model_trained_on": F.lit(dt.date(1997, 12, 31))})
    path = scratch_path(s, "signals")
    fs.write_signals(sig.union(sig), path)
    rows = fs.read_signals(s, path).select("date", "model_trained_on", "confidence.*", F.explode("rankings").alias("r"))
    return rounded(rows.select("date", "r.ticker", "r.rank", "r.predicted_return", "r.recent_mom_5d", "r.current_vol",
                               "r.name", "model_trained_on", "days_since_retrain", "current_vol_regime", "vol_scale",
                               "backtest_sharpe"), 6)


@query("s19_write_signals_keep_first", with_("sig_pos", SIG_COLS.replace("reconstructed,", """CASE
  WHEN date < DATE '1998-01-01' THEN reconstructed ELSE true END AS reconstructed,""")))
def _(s, d):
    sig, path = cl.signals(s, d), scratch_path(s, "signals")
    fs.write_signals(sig.where("date < DATE '1998-01-01'"), path)
    fs.write_signals(sig.withColumn("reconstructed", F.lit(True)), path)   # earlier dates stay as written
    return unnest_signals(fs.read_signals(s, path))


TRADE_COLS = f"""SELECT t.account, symbol, side, volume, open_date, close_date, open_time, close_time,
  {rnd('price AS open_price', 9)}, CASE WHEN close_time IS NOT NULL THEN round(price + 0.5, 9) END AS close_price,
  {rnd('profit', 2)}, note FROM trades t"""


def trade_files(s, d):
    closed = F.col("close_time").isNotNull()
    t = tb.trades(s, d).select("account", "open_time", F.lower("symbol").alias("symbol"), "side", "volume",
                               F.col("price").alias("open_price"), "close_time",
                               F.when(closed, F.col("price") + 0.5).alias("close_price"), "profit", "note")
    path = scratch_path(s, "trades")
    fs.write_trades(t, path)
    return path


def trade_table(df):
    return df.select("account", "symbol", "side", "volume", "open_date", "close_date", "open_time", "close_time",
                     F.round("open_price", 9).alias("open_price"), F.round("close_price", 9).alias("close_price"),
                     F.round("profit", 2).alias("profit"), "note")


@query("s20_read_trades", with_("trades acc", TRADE_COLS + """
LEFT JOIN acc a ON a.account = t.account WHERE a.active_from IS NULL OR open_date >= a.active_from"""))
def _(s, d):
    return trade_table(fs.read_trades(s, trade_files(s, d), tb.accounts(s, d)))


@query("s21_write_trades", with_("trades", TRADE_COLS))
def _(s, d):
    return trade_table(fs.read_trades(s, trade_files(s, d)))


@query("s22_read_snapshots", with_("open_pos", f"""
SELECT account, position_id, symbol, volume, {rnd('price AS openPrice|float_pnl AS profit', 9)} FROM open_pos"""))
def _(s, d):
    path = scratch_path(s, "snapshots")
    fs.write_documents(tb.snapshots(s, d), path)
    p = fs.read_documents(s, path, fs.SNAPSHOT_SCHEMA).select("account", F.explode("positions").alias("p"))
    return rounded(p.select("account", "p.position_id", "p.symbol", "p.volume", "p.openPrice", "p.profit"), 9)


def receipt_files(s, d):
    sig = cl.signals(s, d)
    held = lg.book_at(tb.trades(s, d), sig.select("date"))
    docs = fs.receipts(lg.plan_orders(held, lg.target_book(sig)), held, dt.datetime(2002, 1, 1, 17, 45))
    path = scratch_path(s, "receipts")
    fs.write_documents(docs, path)
    return fs.read_documents(s, path, fs.RECEIPT_SCHEMA)


@query("s23_read_receipts", with_("held", "SELECT date AS signal_date, symbol, side FROM held"))
def _(s, d):
    return receipt_files(s, d).select("signal_date", F.explode("book_before").alias("symbol", "side"))


@query("s24_write_receipts", with_("books", """
SELECT date AS signal_date, 'OK' AS status,
  coalesce(string_agg(CASE WHEN actual IS NOT NULL AND (target IS NULL OR target <> actual) THEN symbol END, ',' ORDER BY symbol), '') AS closes,
  coalesce(string_agg(CASE WHEN target IS NOT NULL AND (actual IS NULL OR target <> actual) THEN symbol || ':' || target END, ',' ORDER BY symbol), '') AS opens
FROM books GROUP BY 1"""))
def _(s, d):
    r = receipt_files(s, d)
    opens = F.transform("planned_opens", lambda x: F.array_join(x, ":"))
    none = F.array().cast("array<string>")
    return r.select("signal_date", "status", F.array_join(F.coalesce("planned_closes", none), ",").alias("closes"),
                    F.array_join(F.coalesce(opens, none), ",").alias("opens"))


@query("s25_latest_snapshot", with_("bars", f"""
SELECT asset, date, {rnd('close', 9)}, DATE '2000-06-30' AS snapshot_date FROM bars
WHERE date <= DATE '2000-06-30' AND close >= 500"""))
def _(s, d):
    p, path = ct.bars(s, d), scratch_path(s, "snapshots")
    p = p.withColumn("close", F.when(F.col("close") >= 500, F.col("close")))
    for day in ("1999-12-31", "2000-06-30"):
        p.where(F.col("date") <= F.lit(day).cast("date")).withColumn(
            "snapshot_date", F.lit(day).cast("date")).write.mode("append").partitionBy("snapshot_date").parquet(path)
    return rounded(fs.latest_snapshot(s, path), 9)


@query("s26_cached_features", with_("feat", f"SELECT asset, date, {rnd('mom_21d vol_21d')} FROM feat"))
def _(s, d):
    path = scratch_path(s, "features")
    fs.cached(s, path, lambda: ts.own_features(ct.bars(s, d)))

    def never():
        raise AssertionError("a stored matrix must be read, not rebuilt")
    return rounded(fs.cached(s, path, never), 8, "asset", "date", "mom_21d", "vol_21d")


@query("s26_keyed_features", with_("feat", f"""
SELECT asset, date, {rnd('mom_21d vol_21d')} FROM feat WHERE asset = 'ASIA' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""))
def _(s, d):
    """Matrices of two keys in one store; the second call of a key reads what is stored."""
    root, lo, hi = scratch_path(s, "matrices"), dt.date(1996, 1, 1), dt.date(1999, 12, 31)

    def build(asset):
        return lambda: ts.own_features(ct.bars(s, d)).where((F.col("asset") == asset) & F.col("date").between(lo, hi))

    def never():
        raise AssertionError("a stored matrix must be read, not rebuilt")
    for asset in ("EUROPE", "ASIA"):
        fs.keyed_matrix(s, root, build(asset), asset, lo, hi)
    return rounded(fs.keyed_matrix(s, root, never, "ASIA", lo, hi), 8, "asset", "date", "mom_21d", "vol_21d")


@query("s20_trades_of_two_layouts", with_("trades acc", TRADE_COLS + """
LEFT JOIN acc a ON a.account = t.account WHERE a.active_from IS NULL OR open_date >= a.active_from"""))
def _(s, d):
    """One account's files have other columns first and older names."""
    path, old = trade_files(s, d), "2-HIGH"
    t = s.read.option("basePath", path).csv(path, header=True, comment="#").where(F.col("account") == old)
    t = t.select("note", "symbol", "profit", F.col("open_time").alias("open_date"), "side", "volume", "close_price",
                 F.col("close_time").alias("close_date"), "open_price", "account")
    mixed = scratch_path(s, "mixed")
    s.read.option("basePath", path).csv(path, header=True, comment="#").where(F.col("account") != old).write.partitionBy(
        "account").csv(mixed, header=True, emptyValue="")
    t.write.mode("append").partitionBy("account").csv(mixed, header=True, emptyValue="")
    return trade_table(fs.read_trades(s, mixed, tb.accounts(s, d)))


@query("s27_missing_history", with_("acc trades", """
SELECT account FROM acc WHERE account NOT IN (SELECT account FROM trades)"""))
def _(s, d):
    return fs.missing_history(tb.accounts(s, d), tb.trades(s, d))
