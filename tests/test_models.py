import datetime as dt

import numpy as np
import pytest
from tests.helpers import day

from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import walkforward as wf
from tidemark.plans import jobs


@pytest.fixture(scope="module")
def planted(spark):
    """Label driven by one of three features."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(140):
        for a in "ABCDE":
            x = rng.normal(size=3)
            rows.append((day(i), a, *map(float, x), float(0.8 * x[0] + 0.3 * rng.normal())))
    return spark.createDataFrame(rows, "date date, asset string, x double, y double, z double, target double").cache()


FEATURES = ["x", "y", "z"]


def test_centred_fit_is_the_all_pairs_fit(spark, planted):
    small = planted.where(f"date < '{day(30)}'")
    coef = md.pairwise_linear(ridge=0.0)(small, FEATURES).model.coefficients.toArray()
    pdf = md.relevance(small).toPandas()
    dx, dr = [], []
    for _, g in pdf.groupby("date"):
        x, r = g[FEATURES].to_numpy(), g["relevance"].to_numpy()
        for i in range(len(g)):
            for j in range(i):
                dx.append(x[i] - x[j])
                dr.append(r[i] - r[j])
    want = np.linalg.lstsq(np.array(dx), np.array(dr, float), rcond=None)[0]
    np.testing.assert_allclose(coef, want, rtol=1e-6)


@pytest.mark.parametrize("fit", [md.pairwise_linear(), md.boosted_trees(max_iter=5, depth=3),
                                 md.elastic_net(0.001), md.quantile_trees(max_iter=3, depth=3)])
def test_fitted_models_find_the_planted_signal(spark, planted, fit):
    p = jobs.model_predictions(planted, wf.Splitter(90, 40, 5), {"m": fit}, FEATURES)
    assert p.count() == 200
    assert mt.ic(p, "run_id").first().ic > 0.5


def test_heavy_penalty_shrinks_to_the_mean(spark, planted):
    predict = md.elastic_net(50.0)(planted, FEATURES)
    assert [v for _, v in md.coefficients(predict, FEATURES)] == [0.0, 0.0, 0.0]


def test_quantile_lies_above_the_point_forecast(spark, planted):
    q = md.quantile_trees(0.9, max_iter=3, depth=3)(planted, FEATURES)(planted)
    share = q.selectExpr("avg(cast(target <= pred as double)) s").first().s
    assert share == pytest.approx(0.9, abs=0.02)


def test_missing_asset_scores_zero(spark, planted):
    predict = md.elastic_net(0.001)(planted, FEATURES)
    latest = planted.where(f"date = '{day(139)}'").where("asset <> 'E'")
    got = {r.asset: r.pred for r in md.score_latest(latest, predict, list("ABCDE")).collect()}
    assert set(got) == set("ABCDE") and got["E"] == 0.0


def test_ranking_backtest_table(spark, planted):
    p = planted.selectExpr("date", "asset", "x as mom_21d", "-x as ret_5d", "y", "target")
    bt = jobs.ranking_backtest(p, 5, wf.Splitter(60, 30, 5), 1, 3.0, vol_target=0.1)
    t = {r.run_id: r for r in bt.table.collect()}
    assert set(t) == {"EqualWeight", "MomentumRank", "MeanReversion"}
    assert t["MomentumRank"].mean_cs_ric > 0.7 and t["EqualWeight"].mean_cs_ric is None
    assert t["EqualWeight"].sharpe is None and t["MomentumRank"].n_folds == 2


def test_stored_model_scores_the_weekly_signal(spark, walk, tmp_path):
    from tidemark.operators import panel as pn
    from tidemark.operators import timeseries as ts
    from tidemark.plans import jobs
    from tidemark.sources import files as fs
    cols = ["ret_5d", "mom_21d"]
    train = ts.forward_log_return(ts.own_features(walk), 5).dropna(subset=[*cols, "target"])
    for day_no, alpha in ((1, 10.0), (2, 0.0)):
        model = md.elastic_net(alpha)(train, cols).model
        fs.register_model(model, str(tmp_path), "net", dt.date(2020, 1, day_no), cols, spark)
        fs.register_model(model, str(tmp_path), "net", dt.date(2020, 1, day_no), cols, spark)
    predict, features, trained = jobs.stored_predictor(spark, str(tmp_path), "net")
    assert features == cols and trained == dt.date(2020, 1, 2)
    got = {r.asset: r.predicted_return for r in jobs.weekly_signal(walk, 5, predict, features).collect()}
    last = pn.latest_rows(ts.own_features(walk), cols).collect()
    w, b = model.coefficients, model.intercept
    for r in last:
        assert abs(got[r.asset] - (w[0] * r.ret_5d + w[1] * r.mom_21d + b)) < 1e-6
    assert sorted(got) == list("ABCD")
