"""Panels, positioning, macro series and trades derived from the base tables.

Bars are the only place where raw fact rows are touched. They are aggregated
map-side to one row per (asset, date) before the shuffle, so a supplier or
region holding a third of all line items sends no more rows than any other.
Suppliers with their regions are counted and broadcast to trades within a bound;
no other join carries a hint: the size of each side is read from the files or from
the finished map stage, and Spark broadcasts only below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cluster import lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(keyed: DataFrame) -> DataFrame:
    """Bars from rows (asset, date, seq, price, cents, quantity). Money is summed
    in whole cents, so a bar is the same to the last bit however its rows were
    split over tasks or recomputed after a lost executor."""
    return finished(partial_bars(keyed, "asset"))


def partial_bars(keyed: DataFrame, key: str) -> DataFrame:
    """Bar parts per (key, date) that can be merged further. All of them are
    fixed-width numbers, so rows are hashed, never sorted."""
    return keyed.groupBy(key, "date").agg(
        F.min("seq").alias("seq"), F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("cents").alias("cents"), F.sum("quantity").alias("volume"))


def merged_bars(parts: DataFrame, key: str) -> DataFrame:
    """Bar parts of several series joined into those of ``key``."""
    return parts.groupBy(key, "date").agg(
        F.min("seq").alias("seq"), F.min_by("open", "seq").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("cents").alias("cents"), F.sum("volume").alias("volume"))


def finished(parts: DataFrame) -> DataFrame:
    return parts.select("asset", "date", "open", "high", "low",
                        F.try_divide(F.col("cents").cast("double") / 100, "volume").alias("close"), "volume")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _bar_input(asset: Column, date: Column) -> list[Column]:
    return [asset.alias("asset"), date.alias("date"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            F.try_divide("l_extendedprice", "l_quantity").alias("price"),
            cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("quantity")]


def suppliers_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(reg, nat.n_regionkey == reg.r_regionkey)
            .select("s_suppkey", F.col("r_name").alias("region")))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per region, one bar per ship date. Lines become parts per supplier
    and date before they meet the suppliers, so raw rows are never shuffled by a
    supplier, however many lines it holds."""
    li, sup = _lines(spark, sf_dir), suppliers_by_region(spark, sf_dir)
    parts = partial_bars(li.select("l_suppkey", *_bar_input(F.lit(""), F.to_date("l_shipdate"))), "l_suppkey")
    rows = parts.join(sup, parts.l_suppkey == sup.s_suppkey).withColumnRenamed("region", "asset")
    return finished(merged_bars(rows, "asset"))


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per return flag and line status, weekly bars dated Monday."""
    asset = F.concat("l_returnflag", "l_linestatus")
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return ohlcv(_lines(spark, sf_dir).select(*_bar_input(asset, week)))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per supplier, weekly bars: a universe that grows with the data."""
    asset = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return ohlcv(_lines(spark, sf_dir).select(*_bar_input(asset, week)))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per event type, one bar per hour (column ``date`` is the hour)."""
    ev = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (ev.groupBy(F.col("event_type").alias("asset"), hour.alias("date"))
            .agg(F.try_divide(F.sum(cents("value")).cast("double") / 100, F.count(F.lit(1)))
                 .alias("close")))


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily series by order priority; a day with one order has no value
    but keeps its row, as an unreleased observation does."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(F.when(F.count(F.lit(1)) >= 2, F.try_divide(
                F.sum(cents("o_totalprice")).cast("double") / 100, F.count(F.lit(1))))
                 .alias("value")))


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly long/short quantities by region, reported for Tuesday."""
    li, sup = _lines(spark, sf_dir), suppliers_by_region(spark, sf_dir)
    q = F.col("l_quantity")

    legs = {"mm_long": F.col("l_returnflag") == "R", "mm_short": F.col("l_returnflag") == "A",
            "prod_long": F.col("l_linestatus") == "F", "prod_short": F.col("l_linestatus") == "O"}
    tuesday = F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 1)
    # Sums per supplier first: raw lines are not shuffled by supplier.
    parts = li.groupBy("l_suppkey", tuesday.alias("report_date")).agg(
        *[F.sum(F.when(cond, q)).alias(name) for name, cond in legs.items()], F.sum(q).alias("oi"))
    return (parts.join(sup, parts.l_suppkey == sup.s_suppkey)
            .groupBy(F.col("region").alias("asset"), "report_date")
            .agg(*[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in legs], F.sum("oi").alias("oi"))
            .withColumn("release_date", F.date_add("report_date", 3)))


OPEN_AFTER = "1998-06-01"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per line item: account = order priority, symbol = region."""
    li, o = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    sup = lookup(suppliers_by_region(spark, sf_dir), "suppliers")   # three joined tables have no useful size estimate
    day_o, day_l = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    opened, closed = F.least(day_o, day_l), F.greatest(day_o, day_l)
    still_open = (F.col("l_linestatus") == "O") & (closed >= F.lit(OPEN_AFTER).cast("date"))
    edge = 5 - F.round(F.col("l_discount") * 100).cast("bigint")
    clock = F.make_dt_interval(secs=F.pmod(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.lit(86340)))
    profit = F.floor(cents("l_extendedprice") * edge / 10000).cast("double") / 100
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(sup, li.l_suppkey == sup.s_suppkey)
            .select(
                F.col("o_orderpriority").alias("account"),
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                            day_l.cast("string")).alias("position_id"),
                F.col("region").alias("symbol"),
                F.when(F.col("l_returnflag") == "A", "sell").otherwise("buy").alias("side"),
                F.round(F.col("l_quantity") / 100, 2).alias("volume"),
                opened.alias("open_date"),
                F.when(~still_open, closed).alias("close_date"),
                (opened.cast("timestamp_ntz") + clock).alias("open_time"),
                F.when(~still_open, closed.cast("timestamp_ntz") + clock).alias("close_time"),
                F.when(~still_open, profit).alias("profit"),
                F.try_divide("l_extendedprice", "l_quantity").alias("price"),
                (F.lit(0.0) - F.col("l_discount")).alias("swap"),
                (F.lit(0.0) - F.col("l_quantity") / 100).alias("commission"),
                F.when(F.col("l_discount") >= 0.1, "fumble").otherwise("swap=0.00")
                .alias("note"), "l_orderkey"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows: an IN deal per trade, an OUT deal once closed, and one balance
    deal per order that belongs to no position."""
    t = trades(spark, sf_dir)
    buy, sell = F.lit("DEAL_TYPE_BUY"), F.lit("DEAL_TYPE_SELL")
    is_buy = F.col("side") == "buy"

    def leg(entry: str, kind: Column, day: str, profit: Column, swap: Column) -> Column:
        return F.struct(kind.alias("type"), F.lit(entry).alias("entry_type"),
                        F.col(day).alias("time"), profit.alias("profit"), swap.alias("swap"))
    none = F.lit(0.0)
    legs = F.array(
        leg("DEAL_ENTRY_IN", F.when(is_buy, buy).otherwise(sell), "open_date", none, none),
        leg("DEAL_ENTRY_OUT", F.when(is_buy, sell).otherwise(buy), "close_date", F.col("profit"),
            F.col("swap")))
    rows = t.select("account", "position_id", "symbol", "volume", "price", "commission",
                    F.explode(F.filter(legs, lambda x: x["time"].isNotNull())).alias("d")).select(
        "account", "position_id", "symbol", "volume", "price", "commission", "d.*")
    balance = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("account"), F.lit("DEAL_TYPE_BALANCE").alias("type"),
        F.to_date("o_orderdate").alias("time"), F.col("o_totalprice").alias("profit"))
    return rows.unionByName(balance, allowMissingColumns=True)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account documents, one per order with open positions (an order has a
    handful of lines, so the nested array stays short)."""
    t = trades(spark, sf_dir).where(F.col("close_date").isNull())
    pos = F.struct(
        "position_id", "symbol", F.when(F.col("side") == "buy", "POSITION_TYPE_BUY")
        .otherwise("POSITION_TYPE_SELL").alias("type"), "volume", F.col("price").alias("openPrice"),
        (F.floor(F.col("price") / 100) - F.col("volume") * 100).alias("profit"))
    return t.groupBy("account", F.col("l_orderkey").alias("doc")).agg(
        F.sort_array(F.collect_list(pos)).alias("positions"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading accounts plus one per order status, which never trades."""
    o = table(spark, sf_dir, "orders")
    live = o.groupBy(F.col("o_orderpriority").alias("account")).agg(
        F.lit(2000.0).alias("start_balance"), F.min(F.to_date("o_orderdate")).alias("_d"))
    live = live.select("account", "start_balance", F.when(
        F.col("account") == "5-LOW", F.date_add("_d", 400)).alias("active_from"))
    idle = o.select(F.concat(F.lit("idle-"), "o_orderstatus").alias("account")).distinct().select(
        "account", F.lit(1970.37).alias("start_balance"), F.lit(None).cast("date").alias("active_from"))
    return live.unionByName(idle)


def universe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One universe per region; nations with many suppliers are ranked, the rest
    give context; cost is known for three regions."""
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n = sup.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_sup"))
    df = nat.join(n, "n_nationkey", "left").join(reg, nat.n_regionkey == reg.r_regionkey)
    cnt = F.coalesce("n_sup", F.lit(0))
    return df.select(
        F.col("r_name").alias("universe"), F.when(cnt >= 4, "ranked").otherwise("context").alias("role"),
        F.col("n_name").alias("asset"), F.col("n_nationkey").alias("pos"),
        (cnt >= 6).alias("late_close"),
        F.when(F.col("r_regionkey") < 3, (F.col("r_regionkey") + 3).cast("double")).alias("cost_bps"))
