import math

import numpy as np
import pytest
from tests.helpers import day

from tidemark.operators import metrics as mt
from tidemark.operators import portfolio as pf

SCHEMA = "run_id string, date date, asset string, pred double, realized double"


def preds(spark, n_dates=80, assets="ABCDEF", seed=5):
    rng = np.random.default_rng(seed)
    rows = [("r", day(i), a, float(np.round(rng.normal(), 1)), float(rng.normal(0, 0.02)))
            for i in range(n_dates) for a in assets]
    rows = [(r, d, a, 0.5 if d == day(7) else p, x) for r, d, a, p, x in rows]     # one flat date
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, n, bps, target=None, cap=2.0, look=21):
    """Dense matrices and one loop over dates."""
    dates = sorted({r[1] for r in rows})
    by = {d: sorted((a, p, x) for _, dd, a, p, x in rows if dd == d) for d in dates}
    prev, net, scales = {}, [], []
    for d in dates:
        pos = {a: 0.0 for a, _, _ in by[d]}
        if np.std([p for _, p, _ in by[d]]) >= 1e-12:
            up = sorted(by[d], key=lambda t: (t[1], t[0]))
            for a, _, _ in up[-n:]:
                pos[a] = 1.0
            for a, _, _ in up[:n]:
                pos[a] = -1.0
        s = 1.0
        if target is not None and len(net) >= look:
            vol = np.std(net[-look:]) * math.sqrt(252)
            s = cap if vol < 1e-8 else min(target / vol, cap)
        pos = {a: v * s for a, v in pos.items()}
        turn = sum(abs(pos[a] - prev.get(a, 0.0)) for a in pos) / (2 * n)
        net.append(sum(pos[a] * x for a, _, x in by[d]) / (2 * n) - turn * bps / 1e4)
        scales.append(s)
        prev = pos
    return net, scales


@pytest.mark.parametrize("n", [1, 2, 3])
def test_sparse_book_profit_equals_the_dense_matrix(spark, n):
    df, rows = preds(spark)
    steps = pf.book_steps(pf.long_short_book(df, n, n), pf.run_dates(df))
    got = [r.net for r in pf.book_pnl(steps, 2 * n, 7.0).orderBy("date").collect()]
    np.testing.assert_allclose(got, brute(rows, n, 7.0)[0], atol=1e-14)


def test_vol_targeting_equals_the_loop(spark):
    df, rows = preds(spark)
    steps = pf.book_steps(pf.long_short_book(df, 2, 2), pf.run_dates(df))
    got = pf.vol_targeted_pnl(steps, 4, 7.0).orderBy("date").toPandas()
    net, scales = brute(rows, 2, 7.0, target=0.10)
    np.testing.assert_allclose(got.net, net, atol=1e-14)
    np.testing.assert_allclose(got.vol_scale, scales, rtol=1e-12)
    assert set(scales[:21]) == {1.0} and len(set(scales)) > 20


def test_flat_predictions_hold_nothing_and_overlap_rules(spark):
    df, _ = preds(spark)
    book = pf.long_short_book(df, 4, 4)
    assert book.where(f"date = '{day(7)}'").count() == 0
    both = pf.long_short_book(df, 4, 4, short_wins=False)
    day0 = f"date = '{day(0)}'"
    assert book.where(day0).agg({"pos": "sum"}).first()[0] == -2.0
    assert both.where(day0).agg({"pos": "sum"}).first()[0] == 2.0


def test_smoothing_starts_short(spark):
    df = spark.createDataFrame([("r", day(i), "A", float(i), 0.0) for i in range(5)], SCHEMA)
    got = [r.pred for r in pf.smooth_predictions(df, 3).orderBy("date").collect()]
    assert got == [0.0, 0.5, 1.0, 2.0, 3.0]


def test_live_ranking_legs_and_long_wins(spark):
    one = spark.createDataFrame([("A", 0.3)], "asset string, pred double")
    assert pf.live_ranking(one).first().position == "LONG"
    many = spark.createDataFrame([(f"a{i}", float(i)) for i in range(9)], "asset string, pred double")
    pos = [r.position for r in pf.live_ranking(many).orderBy("rank").collect()]
    assert pos == ["LONG"] * 3 + ["FLAT"] * 3 + ["SHORT"] * 3


def test_smoothed_ranks_hold_until_a_move(spark):
    moves = [(3, 2, 1), (2, 3, 1), (1, 2, 3), (1, 2, 3)]
    df = spark.createDataFrame([("r", day(i), a, float(p), 0.0) for i, m in enumerate(moves)
                                for a, p in zip("ABC", m)], SCHEMA)
    got = pf.smoothed_ranks(df, 2).where("asset = 'A'").orderBy("date").collect()
    assert [(r["rank"], r.held_rank, r.adopted) for r in got] == [
        (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, False)]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_smoothed_ranks_equal_a_loop_over_vectors(spark, k):
    df, rows = preds(spark, 60)
    held, want = None, {}
    for d in sorted({r[1] for r in rows}):
        order = sorted(((p, a) for _, dd, a, p, _ in rows if dd == d), reverse=True)
        now = {a: i + 1 for i, (_, a) in enumerate(order)}
        if held is None or max(abs(now[a] - held[a]) for a in now) >= k:
            held = now
        want.update({(d, a): v for a, v in held.items()})
    assert {(r.date, r.asset): r.held_rank for r in pf.smoothed_ranks(df, k).collect()} == want


def test_drawdown_starts_at_the_first_curve_value(spark):
    pnl = spark.createDataFrame([("r", day(i), v) for i, v in enumerate([-0.5, 0.1, -0.2, 0.3])],
                                "run_id string, date date, net double")
    r = mt.sharpe_stats(pnl, 1).first()
    assert r.max_drawdown == pytest.approx(-0.2)
    x = np.array([-0.5, 0.1, -0.2, 0.3])
    assert r.sharpe == pytest.approx(x.mean() * 252 / (x.std() * math.sqrt(252)))


def test_subsample_before_or_after_dropping_nulls(spark):
    pnl = spark.createDataFrame([("r", day(i), v) for i, v in enumerate([None, 1.0, 2.0, 3.0, 4.0])],
                                "run_id string, date date, net double")
    assert [r.net for r in mt.every_hth(pnl, 2).orderBy("date").collect()] == [1.0, 3.0]
    assert [r.net for r in mt.every_hth(pnl, 2, False).orderBy("date").collect()] == [2.0, 4.0]


def test_constant_side_and_few_rows_give_null(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(5)] + [("s", 1.0, 2.0), ("s", 2.0, 1.0)],
                               "run_id string, pred double, realized double")
    assert {r.run_id: r.ic for r in mt.ic(df, "run_id").collect()} == {"c": None, "s": None}
    ric = {r.run_id: r.rank_ic for r in mt.rank_ic(df, "run_id", min_rows=2).collect()}
    assert ric["c"] is None and ric["s"] == -1.0


def test_ndcg_by_hand(spark):
    df = spark.createDataFrame([("r", day(0), a, p, x) for a, p, x in
                                (("A", 3.0, 0.1), ("B", 2.0, 0.3), ("C", 1.0, 0.2))], SCHEMA)
    dcg = 0 + 3 / math.log2(3)
    ideal = 3 + 1 / math.log2(3)
    assert mt.ndcg(df, 2).first().ndcg_2 == pytest.approx(dcg / ideal)


def test_verdict_classes(spark):
    t = spark.createDataFrame(
        [("Drift", "X", 0.0, 0.4, 0.5), ("Trees", "X", 0.01, 0.6, 0.9), ("Leak", "X", 0.2, 0.6, 0.9),
         ("Weak", "X", 0.01, 0.4, 0.9), ("Momentum", "X", 0.01, 0.9, 0.9)],
        "model string, series string, pooled_ic double, ic_stability double, sharpe double")
    got = {r.model: r.verdict for r in mt.verdict(t).collect()}
    assert got == {"Drift": "none", "Trees": "edge", "Leak": "leakage", "Weak": "none", "Momentum": "none"}


def test_first_far_is_the_loop():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 200):
        for k in (1, 3, 50):
            r = rng.integers(0, 12, n)
            want = [next((j for j in range(i + 1, n) if abs(r[j] - r[i]) >= k), n) for i in range(n)]
            assert pf.first_far(r, k).tolist() == want


def test_first_far_of_a_long_series_needs_a_few_arrays():
    import tracemalloc
    r = np.random.default_rng(6).integers(0, 1000, 150_000)
    tracemalloc.start()
    at = pf.first_far(r, 1001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (at == len(r)).all() and peak < 60 * r.nbytes
