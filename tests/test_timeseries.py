import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from tests.helpers import day
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import audit, panel
from tidemark.operators import timeseries as ts

SCHEMA = "asset string, date date, close double"


def closes(spark, values, asset="A"):
    return spark.createDataFrame([(asset, day(i), v) for i, v in enumerate(values)], SCHEMA)


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_own_features_match_pandas(spark, walk):
    got = ts.own_features(walk).where("asset = 'A'").orderBy("date").toPandas()
    c = got["close"]
    r = np.log(c / c.shift(1))
    want = {"ret_5d": np.log(c / c.shift(5)), "vol_21d": r.rolling(21).std() * math.sqrt(252),
            "mom_10d": r.rolling(10).mean(), "dist_ma_60": c / c.rolling(60).mean() - 1}
    for k, v in want.items():
        pd.testing.assert_series_equal(got[k], v, check_names=False, rtol=1e-9, atol=1e-12)


def test_null_inside_window_gives_null(spark):
    df = closes(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert [v is None for v in column(ts.distance_from_ma(df, (3,)), "dist_ma_3")] == \
        [True, True, True, True, True, False]


@pytest.mark.parametrize("gap,filled", [(3, True), (4, False)])
def test_fill_limit_counts_rows(spark, gap, filled):
    raw = spark.createDataFrame([("S", day(0), 7.0)], "series_id string, date date, value double")
    cal = spark.createDataFrame([(day(i),) for i in range(gap + 1)], "date date")
    got = column(ts.align_to_calendar(raw, cal, limit=3), "value")
    assert (got[-1] == 7.0) is filled


def test_null_rows_of_the_raw_series_use_up_the_limit(spark):
    raw = spark.createDataFrame([("S", day(0), 7.0), ("S", day(1), None), ("S", day(2), None)],
                                "series_id string, date date, value double")
    cal = spark.createDataFrame([(day(0),), (day(3),)], "date date")
    assert column(ts.align_to_calendar(raw, cal, limit=2), "value") == [7.0, None]


def test_release_on_a_day_off_reaches_the_next_day_only_after_lag(spark):
    cot = spark.createDataFrame(
        [("A", day(-3), day(0), 5.0, 2.0, 1.0, 1.0, 10.0)],
        "asset string, report_date date, release_date date, mm_long double, mm_short double, "
        "prod_long double, prod_short double, oi double")
    cal = spark.createDataFrame([(day(i),) for i in (-1, 1, 2)], "date date")
    got = column(ts.positioning_daily(cot, ["A"], cal), "mm_net")
    assert got == [None, None, 3.0]


def test_lag_below_one_is_refused():
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ts.check_lag(bad)


def test_late_close_gets_one_more_row(spark):
    p = closes(spark, [1.0, 2.0, 4.0, 8.0]).unionByName(closes(spark, [1.0, 3.0, 3.0, 9.0], "X"))
    own = p.where("asset = 'A'")
    now = column(ts.context_returns(p, own, ["X"]), "x_ret_1d")
    late = column(ts.context_returns(p, own, ["X"], ["X"]), "x_ret_1d")
    assert late[1:] == now[:-1] and late[0] is None


def test_label_by_hand_and_non_positive(spark):
    df = closes(spark, [1.0, -5.0, 4.0, 8.0])
    got = column(ts.forward_log_return(df, 2), "target")
    assert got[0] == pytest.approx(math.log(4)) and got[1] is None and got[2] is None
    assert ts.non_positive_closes(df).count() == 1
    with pytest.raises(ValueError):
        ts.forward_log_return(df, 0)


@pytest.mark.parametrize("lam", [0.001, 0.5, 0.7, 0.94, 0.99, 0.999, 0.99999])
def test_ewma_equals_the_recursion_on_a_long_series(spark, lam):
    r = np.random.default_rng(2).normal(0, 0.01, 6500)
    df = spark.createDataFrame([("B", day(i), float(x)) for i, x in enumerate(r)], "asset string, date date, ret double")
    got = ts.ewma_vol(df, lam).orderBy("date").toPandas().ewma_vol.to_numpy(float)
    s2, want = r[0] ** 2, [np.nan]
    for t in range(1, len(r)):
        want.append(math.sqrt(252 * s2))
        s2 = lam * s2 + (1 - lam) * r[t] ** 2
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_garch_equals_a_plain_loop(spark, walk):
    grid = [(0.05, 0.9), (0.1, 0.8)]
    r = ts.log_returns(walk).where("asset = 'A'").select("asset", "date", "ret")
    got = ts.garch_vol(r, 250, 40, grid).orderBy("date").toPandas()
    x = (r.where("ret is not null").orderBy("date").toPandas().ret.to_numpy() * 100) ** 2
    want = np.full(len(x), np.nan)
    for start in range(250, len(x), 40):
        fits = []
        for a, b in grid:
            w = x[:start].mean() * (1 - a - b)
            s, ll = x[:start].mean(), 0.0
            for v in x[:start]:
                ll -= math.log(s) + v / s
                s = w + a * v + b * s
            fits.append((ll, a, b, w, s))
        _, a, b, w, s = max(fits)
        for t in range(start, min(start + 40, len(x))):
            want[t] = math.sqrt(252 * s) / 100
            s = w + a * x[t] + b * s
    np.testing.assert_allclose(got.garch_vol.astype(float), want, rtol=1e-9)


def test_flat_positioning_has_no_range_position(spark):
    rows = [("A", day(7 * i), day(7 * i + 3), 5.0, 2.0, 1.0, 1.0, 0.0) for i in range(30)]
    cot = spark.createDataFrame(
        rows, "asset string, report_date date, release_date date, mm_long double, mm_short double, "
              "prod_long double, prod_short double, oi double")
    df = ts.positioning_weekly(cot)
    assert column(df, "mm_net_pct") == [None] * 30 and column(df, "oi_chg_pct") == [None] * 30


def test_asof_takes_last_row_at_or_before(spark):
    p = closes(spark, [1.0, 2.0, 4.0]).where(F.col("date") != day(1))
    marks = spark.createDataFrame([("A", day(1)), ("A", day(-1)), ("A", day(2))], "asset string, as_of date")
    got = {r.as_of: r.fwd_ret for r in ts.forward_return_asof(p, marks, 1).collect()}
    assert got == {day(1): pytest.approx(math.log(4)), day(-1): None, day(2): None}


def test_carry_sentinel_and_missing_asset(spark, walk):
    cal = ts.trading_calendar(walk, "A")
    df = ts.carry_block(walk, ["A", "B", "Z"], cal, {"A": "C"})
    z = df.where("asset = 'Z'").select("basis_momentum", "rel_basis_momentum", "carry_proxy").distinct()
    assert [tuple(r) for r in z.collect()] == [(0.0, 0.0, 0.0)]
    assert df.where("asset = 'B' and carry_proxy <> 0").count() == 0
    assert df.where("asset = 'A' and carry_proxy is null").count() == 1     # the lag


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(k=st.sampled_from([1, 5, 10, 21, 63]))
def test_truncation_changes_nothing_before_the_cut(spark, walk, k):
    cut = (day(330) - dt.timedelta(days=k)).isoformat()
    own = audit.truncation_diff(walk, ts.own_features, cut, ("asset", "date"), ts.OWN_COLUMNS)
    assert own.where("n_diff > 0").count() == 0
    rel = [f"rel_{c}" for c in panel.CROSS]
    cross = audit.truncation_diff(walk, lambda p: panel.cross_features(p, ts.trading_calendar(p, "A")),
                                  cut, ("asset", "date"), rel)
    assert cross.where("n_diff > 0").count() == 0


def test_truncation_audit_sees_a_leak(spark, walk):
    def leaky(p):
        return p.withColumn("x", F.lead("close", 3).over(ts.hist()))
    bad = audit.truncation_diff(walk, leaky, day(300).isoformat(), ("asset", "date"), ["x"])
    assert bad.first().n_diff > 0


def test_fitted_garch_beats_a_fine_grid(spark):
    rng = np.random.default_rng(2)
    s2, rows = 1.0, []
    for i in range(420):
        r = math.sqrt(s2) * rng.normal()
        rows.append(("A", day(i), r / 100))
        s2 = 0.05 + 0.12 * r * r + 0.83 * s2
    got = ts.fitted_garch_vol(spark.createDataFrame(rows, "asset string, date date, ret double"), 300, 60).orderBy("date").toPandas()
    r2 = np.array([(r * 100) ** 2 for _, _, r in rows])
    fine = [(w, a, b) for w in np.geomspace(0.01, 0.5, 9) for a in np.linspace(0.02, 0.3, 9) for b in np.linspace(0.5, 0.96, 12) if a + b < 1]
    for start in (300, 360):
        s, ll = np.full(len(fine), r2[:start].mean()), np.zeros(len(fine))
        w, a, b = np.array(fine).T
        for v in r2[:start]:
            ll -= np.log(s) + v / s
            s = w + a * v + b * s
        assert got.log_lik[start] >= ll.max() - 1e-6 and got.log_lik[start] >= got.grid_log_lik[start]
    assert got.garch_vol[:300].isna().all() and got.garch_vol[300:].notna().all()
