"""Trade ledger, reconciliation of signals with books, live report tables.

Trades are the large side everywhere: each operator reduces them map-side to
(symbol, day), (symbol, instant) or account rows before any shuffle, and only
the reduced tables meet signals and calendars.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import cut_lineage, lookup, stored
from tidemark.functions.expr import by, safe_div
from tidemark.operators.metrics import rank_ic
from tidemark.operators.timeseries import forward_return_asof

DASH = "—"


# ── deals and books ─────────────────────────────────────────────────────────
def deals_to_trades(deals: DataFrame) -> DataFrame:
    """Pair IN and OUT deals by position; a position without OUT is still open.
    Deals that are no trades, or have no position, are skipped."""
    d = deals.where(F.col("type").isin("DEAL_TYPE_BUY", "DEAL_TYPE_SELL")
                    & F.col("position_id").isNotNull())
    is_in, is_out = F.col("entry_type") == "DEAL_ENTRY_IN", F.col("entry_type") == "DEAL_ENTRY_OUT"

    def latest(cond: Column, value: Column) -> Column:
        return F.max_by(F.when(cond, value), F.when(cond, F.col("time")))
    # A position has one symbol, so that is part of the key; all aggregated values
    # are then of fixed width and the grouping stays a hash aggregate.
    is_buy = F.when(F.col("type") == "DEAL_TYPE_BUY", 1).otherwise(0)
    t = d.groupBy("account", "position_id", F.lower("symbol").alias("symbol")).agg(
        F.min_by("volume", "time").alias("volume"),
        F.max(F.when(is_in, F.col("time"))).alias("open_time"),
        latest(is_in, F.col("price")).alias("open_price"), latest(is_in, is_buy).alias("_buy"),
        F.max(F.when(is_out, F.col("time"))).alias("close_time"),
        latest(is_out, F.col("price")).alias("close_price"),
        F.round(F.sum(F.when(is_out, F.coalesce("profit", F.lit(0.0)))), 2).alias("profit"),
        F.sum(F.coalesce("swap", F.lit(0.0))).alias("_swap"),
        F.sum(F.coalesce("commission", F.lit(0.0))).alias("_comm"))
    t = t.withColumn("side", F.when(F.col("_buy") == 1, "buy").when(F.col("_buy") == 0, "sell"))
    extras = F.format_string("swap=%.2f;commission=%.2f", "_swap", "_comm")
    note = F.when(F.col("close_time").isNull(), F.concat(F.lit("still_open;"), extras)) \
        .otherwise(extras)
    return t.withColumn("note", note).drop("_swap", "_comm", "_buy")


def floating_pnl(snapshots: DataFrame) -> DataFrame:
    """Sum of position profits in the account documents."""
    return (snapshots.select("account", F.explode("positions").alias("p"))
            .groupBy("account").agg(F.sum("p.profit").alias("floating_pnl")))


SIDE_OF = {"LONG": "buy", "SHORT": "sell"}


def target_book(signals: DataFrame) -> DataFrame:
    """(date, symbol, side) that the signal documents ask for."""
    r = signals.select("date", F.explode("rankings").alias("r"))
    side = F.when(F.col("r.position") == "LONG", "buy").when(F.col("r.position") == "SHORT", "sell")
    return r.select("date", F.col("r.mt5").alias("symbol"), side.alias("side")).where(
        F.col("side").isNotNull())


def actual_book(snapshots: DataFrame) -> DataFrame:
    """(account, symbol, side) from position documents, one side per symbol."""
    p = snapshots.select("account", F.explode("positions").alias("p"))
    side = F.when(F.col("p.type") == "POSITION_TYPE_BUY", "buy").otherwise("sell")
    return p.groupBy("account", F.col("p.symbol").alias("symbol")).agg(
        F.max_by(side, F.col("p.position_id")).alias("side"))


NEVER = dt.date(9999, 12, 31)


def _latest_open(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sweep over one symbol's days: trades by their place in order of opening, with the
    first and the last instant of their life, and instants (last until null). Trades go on
    a stack; one that has ended is taken off when it comes to the top, and never looked at
    again, since time only moves on."""
    pdf = pdf.sort_values(["date", "instant", "place"])            # a trade counts on its own day
    stack, out = [], []
    for date, instant, until, side in zip(pdf["date"], pdf["instant"], pdf["until"], pdf["side"]):
        if not instant:
            stack.append((until, side))
            continue
        while stack and stack[-1][0] < date:
            stack.pop()
        if stack:
            out.append((date, pdf["symbol"].iat[0], stack[-1][1]))
    return pd.DataFrame(out, columns=["date", "symbol", "side"])


def nearest_days(days: DataFrame) -> Column:
    """One array over the calendar from the first of ``days(date)`` to the last: of each
    day the last of them up to it and the first from it on."""
    cal = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    w = Window.orderBy("date")            # over the calendar, one row a day
    near = cal.join(days.select("date", F.col("date").alias("d")), "date", "left").select(
        "date", F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.first("d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("after"))
    return near.agg(F.sort_array(F.collect_list(F.struct("date", "before", "after")))).scalar()


def book_at(trades: DataFrame, instants: DataFrame) -> DataFrame:
    """Open side per symbol at 23:59 of each day in ``instants(date)``; the trade
    opened later wins, by the time of day where ``open_time`` is given.

    Trades are read once. Those of a symbol that are open at the same instants, from a
    first to a last, shrink to the one opened latest; those open at none are left out. So
    what leaves a task are at most as many rows as there are such spans, however many
    trades a symbol has. Each symbol then sweeps over these and the instants once."""
    days = stored(instants.select("date").where("date IS NOT NULL").distinct(), "instants")
    near = nearest_days(days)
    low, high = days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar()
    lived = F.date_sub(F.coalesce("close_date", F.lit(NEVER)), 1)            # the last day it is held
    from_ = F.get(near, F.datediff(F.greatest("open_date", low), low))["after"]
    upto = F.get(near, F.datediff(F.least(lived, high), low))["before"]      # null outside the calendar
    order = ["open_date"] + (["open_time"] if "open_time" in trades.columns else [])
    spans = (trades.where(F.col("open_date").isNotNull() & F.col("symbol").isNotNull())
             .select("symbol", from_.alias("date"), upto.alias("until"), *order, "position_id", "side").where("date <= until")
             .groupBy("symbol", "date", "until").agg(F.max(F.struct(*order, "position_id", "side")).alias("t")))
    spans = cut_lineage(spans.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("t")))
                        .select("symbol", "date", F.lit(False).alias("instant"), "until", "place", F.col("t.side").alias("side")))
    asked = spans.select("symbol").distinct().withColumn("date", F.explode(days.agg(F.collect_list("date")).scalar()))
    events = spans.unionByName(asked.withColumn("instant", F.lit(True)), allowMissingColumns=True)
    return events.groupBy("symbol").applyInPandas(_latest_open, "date date, symbol string, side string")


def compare_books(target: DataFrame, actual: DataFrame) -> DataFrame:
    """(date, symbol, target, actual): full outer join of two books."""
    return (target.withColumnRenamed("side", "target")
            .join(actual.withColumnRenamed("side", "actual"), ["date", "symbol"], "full"))


def fidelity_table(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """Did the accounts hold, at the end of each signal day, what was asked?"""
    days = signals.select("date")
    both = compare_books(target_book(signals), book_at(trades, days))
    t, a = F.col("target"), F.col("actual")

    def listed(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("symbol")))), ",")
    rows = both.groupBy("date").agg(
        listed(t.isNotNull() & a.isNull()).alias("missing"),
        listed(t.isNull() & a.isNotNull()).alias("extra"),
        listed(t != a).alias("wrong_dir"))
    cols = ["missing", "extra", "wrong_dir"]
    df = days.distinct().join(rows, "date", "left").select("date", *[
        F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DASH)).alias(c) for c in cols])
    ok = (F.col("missing") == DASH) & (F.col("extra") == DASH) & (F.col("wrong_dir") == DASH)
    return df.withColumn("ok", ok)


def plan_orders(actual: DataFrame, target: DataFrame) -> DataFrame:
    """Orders that turn the actual book into the target; a flip closes first and
    opens again."""
    both = compare_books(target, actual)
    t, a = F.col("target"), F.col("actual")
    differs = t.isNull() | a.isNull() | (t != a)
    closes = both.where(a.isNotNull() & differs).select(
        "date", "symbol", F.lit("close").alias("action"), a.alias("side"))
    opens = both.where(t.isNotNull() & differs).select(
        "date", "symbol", F.lit("open").alias("action"), t.alias("side"))
    return closes.unionByName(opens)


def rebalance_diff(signals: DataFrame) -> DataFrame:
    """Change of the target book from one signal to the next, unchanged legs
    included. The first signal opens everything."""
    w = Window.orderBy("date")            # over signal dates, one row each
    dates = signals.select("date").distinct().withColumn("prev_date", F.lag("date").over(w))
    now = target_book(signals)
    before = (dates.join(now.withColumnRenamed("date", "prev_date"), "prev_date")
              .select("date", "symbol", "side"))
    both = compare_books(now, before)
    t, a = F.col("target"), F.col("actual")
    change = (F.when(a.isNull(), "open").when(t.isNull(), "close")
              .when(t != a, "flip").otherwise("unchanged"))
    return both.select("date", "symbol", a.alias("old_side"), t.alias("new_side"),
                       change.alias("change"))


def guard_violations(signals: DataFrame, snapshots: DataFrame, universe: list[str],
                     today: dt.date, lot: float, max_positions: int = 6,
                     allow_stale: bool = False) -> DataFrame:
    """(rule, subject, n): reasons not to trade; empty means safe."""
    book = target_book(signals)

    def rows(df: DataFrame, rule: str, subject: Column) -> DataFrame:
        return df.groupBy(F.lit(rule).alias("rule"), subject.alias("subject")).agg(
            F.count(F.lit(1)).alias("n"))
    out = rows(book.where(~F.col("symbol").isin(universe)), "signal_outside_universe",
               F.col("symbol"))
    crowded = book.groupBy("date").count().where(F.col("count") > max_positions)
    out = out.unionByName(rows(crowded, "too_many_positions", F.col("date").cast("string")))
    if not allow_stale:
        stale = signals.where(F.col("date") != F.lit(today))
        out = out.unionByName(rows(stale, "stale_signal", F.col("date").cast("string")))
    p = snapshots.select("account", F.explode("positions").alias("p")).select("account", "p.*")
    out = out.unionByName(rows(p.where(~F.col("symbol").isin(universe)), "foreign_position",
                               F.concat_ws(":", "account", "symbol")))
    odd = p.where(F.abs(F.coalesce("volume", F.lit(lot)) - lot) > 1e-9)
    return out.unionByName(rows(odd, "off_size_position", F.concat_ws(":", "account", "symbol")))


def post_trade_check(fidelity: DataFrame) -> DataFrame:
    return fidelity.select("date", F.when(F.col("ok"), "verified").otherwise("mismatch")
                           .alias("status"))


def not_done(signals: DataFrame, receipts: DataFrame) -> DataFrame:
    """Signal dates without a receipt: running twice does nothing twice."""
    done = receipts.select(F.col("signal_date").alias("date")).distinct()
    return signals.join(done, "date", "left_anti")


def next_rebalance(dates: DataFrame, horizon: int = 5) -> DataFrame:
    """The (h+1)-th business day from the first business day at or after."""
    span = F.sequence(F.col("date"), F.date_add("date", 2 * horizon + 9))
    days = F.filter(span, lambda x: ~F.dayofweek(x).isin(1, 7))
    return dates.withColumn("next_rebalance", F.element_at(days, horizon + 1))


# ── skill of the signals ────────────────────────────────────────────────────
def ic_table(signals: DataFrame, prices: DataFrame, h: int = 5, min_pairs: int = 10,
             cost_bps: float = 3.0) -> DataFrame:
    """One row per signal whose forward returns have realised."""
    r = signals.select("date", "feature_date", "reconstructed", F.explode("rankings").alias("r"))
    r = r.select("date", "feature_date", "reconstructed", F.col("r.mt5").alias("asset"),
                 F.col("r.predicted_return").alias("pred"), F.col("r.position").alias("position"))
    fwd = forward_return_asof(prices, r.select("asset", F.col("feature_date").alias("as_of")), h)
    j = r.join(fwd.select("asset", F.col("as_of").alias("feature_date"),
                          F.col("fwd_ret").alias("realized")), ["asset", "feature_date"], "left")
    sign = F.when(F.col("position") == "LONG", 1.0).when(F.col("position") == "SHORT", -1.0)
    j = j.withColumn("_s", sign * F.col("realized"))
    got = F.col("realized").isNotNull()
    base = j.groupBy("date").agg(
        F.count_if(got).alias("n_pairs"), F.count_if(F.col("_s") > 0).alias("hits"),
        F.count_if(got & sign.isNotNull()).alias("n_active"),
        (F.avg("_s") - 2 * cost_bps / 1e4).alias("paper_ret_net"),
        (F.count_if(sign.isNotNull() & ~got) == 0).alias("complete"),
        F.bool_or(F.coalesce("reconstructed", F.lit(False))).alias("reconstructed"))
    base = base.where(F.col("n_pairs") >= min_pairs)
    ric = rank_ic(j.select("date", "pred", "realized"), "date", min_rows=2).withColumnRenamed(
        "rank_ic", "cs_ric")
    return base.join(ric, "date", "left").withColumn(
        "hit_rate", safe_div("hits", F.nullif(F.col("n_active"), F.lit(0))))


def ic_summary(ic: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ic.agg(n.alias("n_weeks"), F.min("date").alias("window_from"),
                  F.max("date").alias("window_to"), F.avg("cs_ric").alias("mean_ric"),
                  F.when(n > 1, F.stddev_samp("cs_ric") / F.sqrt(n)).alias("se_ric"),
                  F.count_if(F.col("cs_ric") > 0).alias("pos_weeks"),
                  F.coalesce(F.sum("paper_ret_net"), F.lit(0.0)).alias("paper_total"))


def skill_call(summary: DataFrame) -> DataFrame:
    m, se = F.col("mean_ric"), F.col("se_ric")
    return summary.withColumn("call", F.when(m - 2 * se > 0, "above chance")
                              .when(m + 2 * se < 0, "below chance").otherwise("too early"))


def unscored(signals: DataFrame, ic: DataFrame) -> DataFrame:
    return signals.select("date").join(ic.select("date"), "date", "left_anti")


# ── realised profit ─────────────────────────────────────────────────────────
def closed(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("profit").isNotNull() & F.col("close_date").isNotNull())


def daily_profit(trades: DataFrame) -> DataFrame:
    return closed(trades).groupBy(F.col("close_date").alias("date"), "symbol").agg(
        F.sum("profit").alias("profit"))


def pnl_timeseries(trades: DataFrame) -> DataFrame:
    """(date, symbol, cum): cumulative realised profit on every calendar day
    between the first and last close, per symbol and for TOTAL."""
    daily = cut_lineage(daily_profit(trades))     # read four times below
    total = daily.groupBy("date").agg(F.lit("TOTAL").alias("symbol"), F.sum("profit").alias("profit"))
    both = daily.unionByName(total)
    span = daily.agg(F.sequence(F.min("date"), F.max("date"))).scalar()
    grid = both.select("symbol").distinct().select("symbol", F.explode(span).alias("date"))
    w = by("symbol").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.join(both, ["symbol", "date"], "left")
    return filled.select("symbol", "date", F.sum(F.coalesce("profit", F.lit(0.0))).over(w)
                         .alias("cum"))


def weekly_pnl(pnl: DataFrame) -> DataFrame:
    """(symbol, week_end, cum, net): value at the last day of each week ending
    Friday and its change; the first week counts from zero."""
    week_end = F.next_day(F.date_sub("date", 1), "FRI")
    wk = pnl.groupBy("symbol", week_end.alias("week_end")).agg(F.max_by("cum", "date").alias("cum"))
    w = by("symbol", order="week_end")
    return wk.withColumn("net", F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0)))


def weekly_pair_pnl(pnl: DataFrame) -> DataFrame:
    """Weekly change per symbol; symbols that never moved are left out."""
    wk = weekly_pnl(pnl.where(F.col("symbol") != "TOTAL"))
    moved = wk.groupBy("symbol").agg(F.sum(F.abs("net")).alias("s")).where("s > 0").select("symbol")
    return wk.join(moved, "symbol", "left_semi")


def pair_pnl(trades: DataFrame) -> DataFrame:
    return closed(trades).groupBy("symbol").agg(F.sum("profit").alias("pnl")).where(
        F.round("pnl", 6) != 0).orderBy("pnl")


def pair_stats(trades: DataFrame) -> DataFrame:
    return closed(trades).groupBy("symbol").agg(
        F.sum("profit").alias("pnl"), F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("profit") > 0).alias("n_wins")).where(F.round("pnl", 6) != 0)


def current_positions(signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Book of the latest signal with open price and floating profit."""
    last = signals.agg(F.max("date")).scalar()
    r = signals.where(F.col("date") == last).select(F.explode("rankings").alias("r")).select("r.*")
    r = r.where(F.col("position").isin("LONG", "SHORT"))
    p = snapshots.select(F.explode("positions").alias("p")).groupBy(
        F.col("p.symbol").alias("mt5")).agg(
        F.max_by(F.struct(F.col("p.openPrice").alias("openPrice"), F.col("p.profit").alias("profit")),
                 F.col("p.position_id")).alias("p"))
    return r.join(p, "mt5", "left").select(
        F.col("mt5").alias("symbol"),
        F.when(F.col("position") == "LONG", "BUY").otherwise("SELL").alias("side"),
        "predicted_return", F.col("p.openPrice").alias("open_price"),
        F.col("p.profit").alias("floating_pnl"))


def account_stats(accounts: DataFrame, trades: DataFrame) -> DataFrame:
    """Closed profit, trades and open count; accounts without trades stay."""
    t = trades.groupBy("account").agg(
        F.sum("profit").alias("closed_pnl"),
        F.count_if(F.col("profit").isNotNull()).alias("n_trades"),
        F.count_if(F.col("close_date").isNull()).alias("n_open"))
    return accounts.join(t, "account", "left").fillna(0, ["closed_pnl", "n_trades", "n_open"])


def trade_stats(trades: DataFrame) -> DataFrame:
    """Win rate, average win and loss, expectancy, best and worst trade."""
    p = F.col("profit")
    t = closed(trades).agg(
        F.count(F.lit(1)).alias("n_closed"), F.count_if(p > 0).alias("n_winners"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss"),
        F.max(F.struct("profit", "symbol")).alias("b"), F.min(F.struct("profit", "symbol")).alias("w"))
    t = t.withColumn("win_rate", safe_div("n_winners", F.nullif(F.col("n_closed"), F.lit(0))))
    wr = F.col("win_rate")
    return t.select("n_closed", "n_winners", "win_rate", "avg_win", "avg_loss",
                    (wr * F.col("avg_win") + (1 - wr) * F.col("avg_loss")).alias("expectancy"),
                    F.col("b.symbol").alias("best_symbol"), F.col("b.profit").alias("best_profit"),
                    F.col("w.symbol").alias("worst_symbol"), F.col("w.profit").alias("worst_profit"))


def noted(trades: DataFrame, token: str) -> DataFrame:
    return closed(trades).where(F.contains("note", F.lit(token))).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("pnl"))


def wallet(trades: DataFrame, floating: DataFrame, start: float) -> DataFrame:
    """Start capital + closed profit + floating profit."""
    one = F.lit(1).alias("_k")
    c = closed(trades).agg(F.coalesce(F.sum("profit"), F.lit(0.0)).alias("closed_pnl")).select("*", one)
    f = floating.agg(F.coalesce(F.sum("floating_pnl"), F.lit(0.0)).alias("floating_pnl")).select("*", one)
    return c.join(f, "_k").select(
        "closed_pnl", "floating_pnl", (F.col("closed_pnl") + F.col("floating_pnl")).alias("total_pnl"),
        (F.lit(start) + F.col("closed_pnl") + F.col("floating_pnl")).alias("wallet_value"))


def draw(path: Column, week: Column, seed: int, n: Column) -> Column:
    """Portable pseudo-random index in [0, n): leading digits of a digest of path,
    week and seed, so draws are independent between weeks and between paths, and
    the same on any engine and after any retry."""
    digest = F.md5(F.concat_ws(":", path.cast("string"), week.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), n)


def project_wallet(weekly: DataFrame, start: float, weeks: int = 12, n_paths: int = 4000,
                   seed: int = 7, min_obs: int = 4) -> DataFrame:
    """Resample observed weekly profit: p10 / p50 / p90 wallet by week ahead.
    Empty with fewer than ``min_obs`` weeks. Paths are generated in parallel; the
    week's percentiles hold ``n_paths`` numbers."""
    spark = weekly.sparkSession
    obs = weekly.where(F.col("net").isNotNull()).select(
        (F.row_number().over(Window.orderBy("week_end")) - 1).cast("bigint").alias("i"), "net")
    n = obs.agg(F.count(F.lit(1))).scalar()
    ahead = F.sequence(F.lit(1).cast("bigint"), F.lit(weeks).cast("bigint"))
    steps = spark.range(n_paths).select(F.col("id").alias("path"), F.explode(ahead).alias("week"))
    steps = steps.withColumn("n", n).where(F.col("n") >= min_obs)
    drawn = steps.withColumn("i", draw(F.col("path"), F.col("week"), seed, F.col("n"))).join(obs, "i")
    w = Window.partitionBy("path").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    path = drawn.select("week", (F.lit(start) + F.sum("net").over(w)).alias("value"))
    first = obs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_obs).select(
        F.lit(0).cast("bigint").alias("week"), F.lit(start).alias("value"))
    return path.unionByName(first).groupBy("week").agg(*[
        F.percentile("value", q / 100).alias(f"p{q}") for q in (10, 50, 90)])


def wallet_curve(pnl: DataFrame, start: float) -> DataFrame:
    return pnl.where("symbol = 'TOTAL'").select("date", (F.lit(start) + F.col("cum")).alias("wallet"))


#: Accounts that are broadcast at most; trades of few accounts are not shuffled by them.
ACCOUNTS = 50_000


def active_trades(trades: DataFrame, accounts: DataFrame) -> DataFrame:
    """Drop trades opened before their account went live."""
    a = lookup(accounts.select("account", "active_from"), "accounts", ACCOUNTS)
    return (trades.join(a, "account", "left")
            .where(F.col("active_from").isNull() | (F.col("open_date") >= F.col("active_from")))
            .drop("active_from"))


def reconstructed_weeks(signals: DataFrame) -> DataFrame:
    return signals.where("reconstructed").select("date")


def recent_weeks(pnl: DataFrame, n: int = 16) -> DataFrame:
    w = Window.orderBy(F.desc("week_end"))        # one row per week
    return (weekly_pnl(pnl.where("symbol = 'TOTAL'")).withColumn("ago", F.row_number().over(w))
            .where(F.col("ago") <= n).select("week_end", "ago", "net"))


def last_week_movers(pnl: DataFrame) -> DataFrame:
    wk = weekly_pair_pnl(pnl)
    last = wk.agg(F.max("week_end")).scalar()
    return wk.where(F.col("week_end") == last).select("symbol", "net").orderBy(F.desc("net"))


def fidelity_summary(fidelity: DataFrame) -> DataFrame:
    return fidelity.agg(F.count_if("ok").alias("n_clean"), F.count(F.lit(1)).alias("n_all"))
