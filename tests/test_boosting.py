import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import day
from tidemark.operators import boosting as bo
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import walkforward as wf

HOW = {"rounds": 4, "depth": 2, "step": 0.4}


@pytest.fixture(scope="module")
def planted(spark):
    """A label of two steps and a slope; six assets a date, one of them with gaps."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(130):
        for a in "ABCDEF":
            if a == "F" and i % 5 == 0:
                continue
            x = rng.normal(size=3)
            y = 1.5 * (x[0] > 0.3) - 1.0 * (x[1] > 0) + 0.3 * rng.normal()
            rows.append((day(i), a, *map(float, x), float(y)))
    panel = spark.createDataFrame(rows, "date date, asset string, x double, y double, z double, target double")
    ax = wf.date_axis(panel)
    dates = wf.date_folds(ax, wf.folds(wf.axis_counts(ax), wf.Splitter(80, 20, 5)))
    return bo.fold_parts(panel, dates).cache()


FEATURES = ["x", "y", "z"]


def test_parts_leave_a_gap_and_never_look_ahead(planted):
    edges = planted.groupBy("fold_id").agg(*[f(F.when(F.col("part") == p, F.col("idx"))).alias(f"{p}_{f.__name__}")
                                             for p in ("fit", "val", "test") for f in (F.min, F.max)]).collect()
    for r in edges:
        assert r.val_min - r.fit_max == 6 and r.test_min - r.val_max == 6 and r.val_max - r.val_min + 1 == max(10, int(0.15 * (80 + 20 * r.fold_id)))


def test_squared_and_pinball_trees(planted):
    out = bo.boost(planted, ["fold_id"], FEATURES, {"mean": None, "q10": 0.1, "q50": 0.5, "q90": 0.9}, **HOW).cache()
    n = planted.where("part = 'test'").count()
    got = {r["model"]: r for r in out.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.corr("pred", "realized").alias("c"),
        F.avg((F.col("realized") <= F.col("pred")).cast("double")).alias("below")).collect()}
    assert {r["n"] for r in got.values()} == {n}
    assert got["mean"]["c"] > 0.85 and got["q50"]["c"] > 0.7
    assert abs(got["q50"]["below"] - 0.5) < 0.1
    assert got["q10"]["below"] < 0.3 < 0.7 < got["q90"]["below"]


def test_listwise_gradients_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(bo, "TOP", 3)
    rng = np.random.default_rng(6)
    n = 9
    rel, score = rng.permutation(n), rng.choice([0.0, 0.5, 1.0], n)
    gains = 2.0 ** (rel - n + 1) - 2.0 ** (1 - n)
    ideal = sum((2.0 ** -p - 2.0 ** (1 - n)) / np.log2(p + 2) for p in range(3))
    names = "ABCDEFGHI"
    rows = [(0, "fit", day(0), names[i], int(rel[i]), float(gains[i]), float(ideal), float(score[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, part string, date date, asset string, rel int, gain double, ideal double, score double")
    place = {a: p + 1 for p, a in enumerate(sorted(range(n), key=lambda i: (-score[i], names[i])))}
    disc = [1 / np.log2(place[i] + 1) if place[i] <= 3 else 0.0 for i in range(n)]
    for r in bo.lambdas(df, ["k"]).collect():
        i, g, h = names.index(r["asset"]), 0.0, 0.0
        for j in range(n):
            if j != i:
                up = 1.0 if rel[i] > rel[j] else -1.0
                rho = 1 / (1 + np.exp(up * (score[i] - score[j])))
                d = abs(gains[i] - gains[j]) * abs(disc[i] - disc[j]) / ideal
                g, h = g + up * rho * d, h + rho * (1 - rho) * d
        assert r["g"] == pytest.approx(g) and r["h"] == pytest.approx(h)


def test_listwise_trees_rank_better_than_the_linear_pairs(spark, planted):
    trees = bo.listwise(planted, ["fold_id"], FEATURES, **HOW)
    train = planted.where("fold_id = 0 AND part <> 'test'").select("date", "asset", *FEATURES, "target")
    linear = md.pairwise_linear()(train, FEATURES)(planted.where("part = 'test'")).select(
        "fold_id", "date", "asset", "pred", F.col("target").alias("realized"))
    both = trees.withColumn("run_id", F.lit("trees")).unionByName(linear.withColumn("run_id", F.lit("linear")))
    got = {r["run_id"]: r["m"] for r in mt.ndcg(both, 3).groupBy("run_id").agg(F.avg("ndcg_3").alias("m")).collect()}
    assert got["trees"] > got["linear"] > 0.6


def test_too_short_a_history_has_no_val_rows(spark, planted):
    small = planted.where("fold_id = 0 AND part <> 'val'")
    out = bo.boost(small, ["fold_id"], FEATURES, {"m": None}, rounds=2, depth=1, step=0.5)
    assert out.count() == small.where("part = 'test'").count() and out.where("pred IS NULL").count() == 0
