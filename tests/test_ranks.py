import numpy as np
import pandas as pd
from tests.helpers import day
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ranks


def test_ranks_equal_pandas_with_a_hot_value_and_group(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.5, "hot", rng.choice(list("abc"), 3000))
    v = np.where(rng.random(3000) < 0.35, 1.5, np.round(rng.normal(size=3000), 2))
    pdf = pd.DataFrame({"i": range(3000), "g": g, "v": v})
    df = spark.createDataFrame(pdf)
    got = ranks.average_rank(df, ["g"], "v", "r").toPandas().sort_values("i").r.to_numpy(float)
    np.testing.assert_array_equal(got, pdf.groupby("g").v.rank().to_numpy())


def test_null_keys_and_values_rank_as_in_a_window(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k == 3 else "abc"[k], None if rng.random() < 0.2 else float(rng.integers(9)), i)
            for i, k in enumerate(rng.integers(0, 4, 400))]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    w = Window.partitionBy("k").orderBy("v")
    want = df.select("k", "i", (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("k", "v")) - 1) / 2)
                     .alias("r"))
    got = ranks.average_rank(df, ["k"], "v", "r").select("k", "i", "r")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 400
    want = df.select("k", "i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "i")).alias("r"))
    got = ranks.row_rank(df, ["k"], [F.desc("v"), "i"], "r").select("k", "i", "r")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 400


def test_extremes_limit_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(day(0), f"a{i:03d}", float(i % 50)) for i in range(500)],
                               "date date, asset string, pred double")
    top = ranks.extremes(df, ["date"], "pred", "asset", 2, 2)
    assert sorted((r.asset, r.side) for r in top.collect()) == [
        ("a000", -1.0), ("a050", -1.0), ("a449", 1.0), ("a499", 1.0)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4      # partial and final, both ends
