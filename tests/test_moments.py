import numpy as np
import pytest

from tests.helpers import day
from tidemark.operators import moments as mo
from tidemark.operators import walkforward as wf


def series(spark, n=160, assets="AB"):
    rng = np.random.default_rng(3)
    rows = []
    for a in assets:
        x = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1]
        y = 0.5 * x[:, 0] - 0.02 * x[:, 1] + 0.1 * rng.normal(size=n)
        rows += [(a, day(i), *map(float, x[i]), 2.0, float(y[i]) if i % 17 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, date date, x double, y double, z double, flat double, target double")
    rows = df.join(wf.date_axis(df, "asset"), ["asset", "date"])
    return rows, rows.toPandas()


SPLITS = [wf.Splitter(60, 20, 5), wf.Splitter(60, 20, 5, train_window=40), wf.Splitter(60, 20, 0, n_splits=2)]


@pytest.mark.parametrize("sp", SPLITS)
def test_statistics_of_ranges_without_copies(spark, sp):
    rows, pdf = series(spark)
    fd = wf.folds(wf.axis_counts(rows, "asset"), sp, "asset")
    got = {(r["asset"], r["fold_id"]): r for r in mo.fold_statistics(rows, fd, "y", "asset").collect()}
    for f in fd.collect():
        part = pdf[(pdf.asset == f.asset) & (pdf.idx >= f.train_lo) & (pdf.idx < f.train_hi)].dropna(subset=["target"])
        r = got[f.asset, f.fold_id]
        assert r["train_rows"] == len(part)
        assert r["train_mean"] == pytest.approx(part.target.mean()) and r["train_sd"] == pytest.approx(part.y.std(ddof=0))


def test_descent_ends_at_the_optimum(spark):
    rows, pdf = series(spark)
    fd = wf.folds(wf.axis_counts(rows, "asset"), SPLITS[0], "asset")
    features, alpha, ratio = ["x", "y", "z", "flat"], 0.02, 0.5
    m = mo.fold_moments(rows, fd, [*features, "target"], "asset")
    ranges = {(f.asset, f.fold_id): f for f in fd.collect()}
    for r in mo.elastic_net(m, 4, alpha, ratio).collect():
        f = ranges[r["asset"], r["fold_id"]]
        part = pdf[(pdf.asset == f.asset) & (pdf.idx >= f.train_lo) & (pdf.idx < f.train_hi)].dropna(subset=["target"])
        x, y = part[features].to_numpy(), part.target.to_numpy()
        sd = np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
        z, w = (x - x.mean(axis=0)) / sd, np.array(r["coef"]) * sd
        slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - ratio) * w
        assert w[3] == 0.0
        for s, v in zip(slope, w):                     # the slope balances the penalty, or stays within it at zero
            assert abs(s - alpha * ratio * np.sign(v)) < 1e-9 if v else abs(s) <= alpha * ratio + 1e-12
        assert r["intercept"] == pytest.approx(y.mean() - np.array(r["coef"]) @ x.mean(axis=0))

