import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.helpers import day

from tidemark.operators import ledger as lg
from tidemark.sources.files import SIGNAL_SCHEMA

TRADES = ("account string, position_id string, symbol string, side string, open_date date, "
          "close_date date, profit double, note string")


def signal(spark, *days_books):
    rows = [{"date": d, "feature_date": d, "reconstructed": False, "rankings": [
        {"rank": i, "ticker": s, "mt5": s, "position": p, "predicted_return": 1.0 / i}
        for i, (s, p) in enumerate(book, 1)]} for d, book in days_books]
    return spark.createDataFrame(rows, SIGNAL_SCHEMA)


def trades(spark, *rows):
    return spark.createDataFrame(rows, TRADES)


def test_trade_closing_at_the_instant_is_closed_and_later_open_wins(spark):
    t = trades(spark, ("a", "1", "X", "buy", day(0), day(5), 1.0, ""),
               ("a", "2", "Y", "buy", day(0), None, None, ""), ("a", "3", "Y", "sell", day(3), day(4), 1.0, ""))
    at = spark.createDataFrame([(day(i),) for i in range(-1, 7)], "date date")
    got = {(r.date, r.symbol): r.side for r in lg.book_at(t, at).collect()}
    assert (day(4), "X") in got and (day(5), "X") not in got
    assert [got[(day(i), "Y")] for i in range(7)] == ["buy"] * 3 + ["sell"] + ["buy"] * 3
    assert not [k for k in got if k[0] == day(-1)]


def test_book_at_equals_brute_force_with_a_hot_symbol(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        o = int(rng.integers(0, 200))
        life = int(rng.integers(0, 90)) if rng.random() < 0.9 else None
        rows.append(("a", f"{i:04d}", "HOT" if rng.random() < 0.6 else str(rng.choice(["P", "Q"])),
                     str(rng.choice(["buy", "sell"])), day(o), None if life is None else day(o + life), 1.0, ""))
    at = [day(i) for i in range(0, 260, 9)]
    got = {(r.date, r.symbol): r.side for r in lg.book_at(
        trades(spark, *rows), spark.createDataFrame([(d,) for d in at], "date date")).collect()}
    want = {}
    for d in at:
        for _, pid, sym, side, o, c, *_ in sorted(rows, key=lambda r: (r[4], r[1])):
            if o <= d and (c is None or c > d):
                want[(d, sym)] = side
    assert got == want


def test_fidelity_lists_and_flip_orders(spark):
    sig = signal(spark, (day(1), [("A", "LONG"), ("B", "SHORT"), ("C", "LONG"), ("D", "FLAT")]))
    t = trades(spark, ("a", "1", "A", "buy", day(0), None, None, ""), ("a", "2", "B", "buy", day(0), None, None, ""),
               ("a", "3", "Z", "buy", day(0), None, None, ""))
    r = lg.fidelity_table(sig, t).first()
    assert (r.missing, r.extra, r.wrong_dir, r.ok) == ("C", "Z", "B", False)
    plan = lg.plan_orders(lg.book_at(t, sig.select("date")), lg.target_book(sig))
    assert {(x.symbol, x.action, x.side) for x in plan.collect()} == {
        ("B", "close", "buy"), ("B", "open", "sell"), ("C", "open", "buy"), ("Z", "close", "buy")}
    done = lg.post_trade_check(lg.fidelity_table(sig, t)).first()
    assert done.status == "mismatch"


def test_rebalance_diff(spark):
    sig = signal(spark, (day(0), [("A", "LONG"), ("B", "SHORT")]), (day(7), [("A", "SHORT"), ("C", "LONG")]))
    got = {(r.date, r.symbol): r.change for r in lg.rebalance_diff(sig).collect()}
    assert got == {(day(0), "A"): "open", (day(0), "B"): "open", (day(7), "A"): "flip",
                   (day(7), "B"): "close", (day(7), "C"): "open"}


def test_guard_rules(spark):
    sig = signal(spark, (day(0), [("A", "LONG"), ("Q", "SHORT")]))
    snap = spark.createDataFrame(
        [("a", [("1", "A", "POSITION_TYPE_BUY", 0.02, 1.0, 0.0), ("2", "F", "POSITION_TYPE_BUY", 0.01, 1.0, 0.0)])],
        "account string, positions array<struct<position_id: string, symbol: string, type: string, "
        "volume: double, openPrice: double, profit: double>>")
    got = {(r.rule, r.subject) for r in lg.guard_violations(sig, snap, ["A", "B"], day(1), 0.01, 1).collect()}
    assert got == {("signal_outside_universe", "Q"), ("too_many_positions", str(day(0))),
                   ("stale_signal", str(day(0))), ("foreign_position", "a:F"), ("off_size_position", "a:A")}
    calm = lg.guard_violations(sig, snap, ["A", "Q", "F"], day(1), 0.01, 6, allow_stale=True)
    assert [r.rule for r in calm.collect()] == ["off_size_position"]


def test_next_rebalance_counts_business_days(spark):
    d = spark.createDataFrame([(dt.date(2026, 11, 13),), (dt.date(2026, 11, 14),)], "date date")
    got = {r.date: r.next_rebalance for r in lg.next_rebalance(d, 5).collect()}
    assert got == {dt.date(2026, 11, 13): dt.date(2026, 11, 20), dt.date(2026, 11, 14): dt.date(2026, 11, 23)}


def test_deals_pair_up_and_stay_open(spark):
    rows = [("a", "1", "DEAL_TYPE_BUY", "DEAL_ENTRY_IN", day(0), "EURUSD", 0.01, 1.1, 0.0, 0.0, -0.02),
            ("a", "1", "DEAL_TYPE_SELL", "DEAL_ENTRY_OUT", day(2), "EURUSD", 0.01, 1.2, 5.0, 0.5, -0.02),
            ("a", "1", "DEAL_TYPE_SELL", "DEAL_ENTRY_OUT", day(3), "EURUSD", 0.01, 1.3, 2.5, 0.0, 0.0),
            ("a", "2", "DEAL_TYPE_SELL", "DEAL_ENTRY_IN", day(1), "GBPUSD", 0.01, 1.5, 0.0, 0.0, -0.02),
            ("a", None, "DEAL_TYPE_BALANCE", None, day(0), None, None, None, 2000.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "account string, position_id string, type string, entry_type string, "
                                    "time date, symbol string, volume double, price double, profit double, "
                                    "swap double, commission double")
    got = {r.position_id: r for r in lg.deals_to_trades(d).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].side, got["1"].symbol, got["1"].profit, got["1"].close_time, got["1"].close_price) == (
        "buy", "eurusd", 7.5, day(3), 1.3)
    assert got["1"].note == "swap=0.50;commission=-0.04"
    assert got["2"].note.startswith("still_open;") and got["2"].profit is None


def test_profit_calendar_week_and_accounts(spark):
    t = trades(spark, ("a", "1", "X", "buy", day(0), dt.date(2026, 11, 5), 3.0, "fumble"),
               ("a", "2", "Y", "buy", day(0), dt.date(2026, 11, 7), -1.0, ""),
               ("a", "3", "Y", "buy", day(0), None, None, ""))
    pnl = lg.pnl_timeseries(t)
    assert {r.symbol: r.n for r in pnl.groupBy("symbol").count().withColumnRenamed("count", "n").collect()} == \
        {"X": 3, "Y": 3, "TOTAL": 3}
    wk = lg.weekly_pnl(pnl.where("symbol = 'TOTAL'")).orderBy("week_end").collect()
    assert [(r.week_end, r.net) for r in wk] == [(dt.date(2026, 11, 6), 3.0), (dt.date(2026, 11, 13), -1.0)]
    acc = spark.createDataFrame([("a", 2000.0), ("b", 1500.0)], "account string, start_balance double")
    got = {r.account: (r.closed_pnl, r.n_trades, r.n_open) for r in lg.account_stats(acc, t).collect()}
    assert got == {"a": (2.0, 2, 1), "b": (0.0, 0, 0)}
    s = lg.trade_stats(t).first()
    assert (s.win_rate, s.avg_win, s.avg_loss, s.expectancy, s.best_symbol) == (0.5, 3.0, -1.0, 1.0, "X")
    assert tuple(lg.noted(t, "fumble").first()) == (1, 3.0)


def test_projection_needs_four_weeks(spark):
    wk = spark.createDataFrame([(day(7 * i), float(i)) for i in range(3)], "week_end date, net double")
    assert lg.project_wallet(wk, 100.0, n_paths=50).count() == 0
    wk = spark.createDataFrame([(day(7 * i), 2.0) for i in range(4)], "week_end date, net double")
    rows = lg.project_wallet(wk, 100.0, weeks=3, n_paths=50).orderBy("week").collect()
    assert [(r.week, r.p10, r.p90) for r in rows] == [(i, 100.0 + 2 * i, 100.0 + 2 * i) for i in range(4)]


def test_draws_are_uniform_and_independent_between_weeks(spark):
    n, paths, weeks = 50, 2000, 6
    rows = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"))
    got = rows.select("path", "week", lg.draw(F.col("path"), F.col("week"), 7, F.lit(n)).alias("i")).toPandas()
    x = got.pivot(index="path", columns="week", values="i").to_numpy()
    assert x.min() == 0 and x.max() == n - 1 and len(np.unique(x, axis=0)) > 0.99 * paths
    counts = np.bincount(x.ravel(), minlength=n)
    assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < 95                  # chi-square, 49 dof
    for a in range(weeks):
        for b in range(a):
            assert abs(np.corrcoef(x[:, a], x[:, b])[0, 1]) < 0.09
            assert len(np.unique((x[:, a] - x[:, b]) % n)) == n


def test_projection_spreads_as_a_resample_does(spark):
    net = np.random.default_rng(1).normal(3, 20, 40)
    wk = spark.createDataFrame([(day(7 * i), float(v)) for i, v in enumerate(net)], "week_end date, net double")
    last = lg.project_wallet(wk, 0.0, weeks=9).where("week = 9").first()
    spread = 2 * 1.2816 * net.std() * 3
    assert abs((last.p90 - last.p10) - spread) < 0.08 * spread and abs(last.p50 - 9 * net.mean()) < 0.1 * spread


@pytest.mark.parametrize("mean,se,call", [(0.1, 0.01, "above chance"), (-0.1, 0.01, "below chance"),
                                          (0.01, 0.1, "too early")])
def test_skill_call(spark, mean, se, call):
    df = spark.createDataFrame([(mean, se)], "mean_ric double, se_ric double")
    assert lg.skill_call(df).first().call == call


def test_book_sweep_against_every_pair_of_days(spark):
    import random
    rng = random.Random(8)
    rows = []
    for k in range(300):
        o = rng.randrange(60)
        rows.append((f"{k:04d}", "HOT" if k % 3 else rng.choice("ABC"), rng.choice(["buy", "sell"]), day(o),
                     None if rng.random() < 0.02 else day(o + rng.randrange(0, 12))))
    trades = spark.createDataFrame(rows, "position_id string, symbol string, side string, open_date date, close_date date")
    days = [day(i) for i in range(0, 75, 3)]
    want = set()
    for d in days:
        for sym in {"HOT", "A", "B", "C"}:
            held = [r for r in rows if r[1] == sym and r[3] <= d and (r[4] is None or r[4] > d)]
            if held:
                want.add((d, sym, max(held, key=lambda r: (r[3], r[0]))[2]))
    got = {tuple(r) for r in lg.book_at(trades, spark.createDataFrame([(d,) for d in days], "date date")).collect()}
    assert got == want


def test_book_reads_trades_once_and_sends_a_row_per_span(spark):
    """Many trades on two instants: each is looked at once, whatever wins."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = [("a", f"{i:04d}", "XYZ"[i % 3], ["buy", "sell"][i % 2], day(i % 10), day(i % 10 + i % 4 + 1) if i % 5 else None, 1.0, "")
            for i in range(600)]
    rows += [("a", "n", None, "buy", day(0), None, 1.0, ""), ("a", "o", "X", "buy", None, None, 1.0, "")]
    t = trades(spark, *rows).mapInArrow(counted, TRADES)
    days = [day(2), day(7)]
    got = {(r.date, r.symbol): r.side for r in lg.book_at(t, spark.createDataFrame([(d,) for d in [*days, None]], "date date")).collect()}
    want = {}
    for d in days:
        for s in "XYZ":
            live = [r for r in rows if r[2] == s and r[4] and r[4] <= d and (r[5] is None or r[5] > d)]
            if live:
                want[d, s] = max(live, key=lambda r: (r[4], r[1]))[3]
    assert got == want and seen.value == len(rows)


def test_trades_are_not_shuffled_to_meet_accounts(spark):
    t = trades(spark, ("a", "1", "X", "buy", day(0), day(5), 1.0, ""), ("b", "2", "X", "buy", day(3), None, None, ""))
    accounts = spark.createDataFrame([("a", day(1)), ("b", None)], "account string, active_from date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = lg.active_trades(t, accounts)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and [r.position_id for r in got.collect()] == ["2"]
