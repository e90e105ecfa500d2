"""Baselines as column expressions and MLlib models fitted fold by fold.

The driver loops over folds only to start fits; rows stay in Spark. Labels and
group statistics are aggregates, and the rank objective needs no pairs: summed
over all pairs of a date, squared differences equal n times squared deviations
from the date's mean, so a weighted fit on centred rows is the pairwise fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import row_rank
from tidemark.operators.walkforward import time_tail

Fit = Callable[[DataFrame, Sequence[str]], Callable[[DataFrame], DataFrame]]


# ── baselines ───────────────────────────────────────────────────────────────
def _named(rows: DataFrame, name: str, pred: F.Column) -> DataFrame:
    return rows.withColumn("model", F.lit(name)).withColumn("pred", pred)


def random_walk(test: DataFrame) -> DataFrame:
    return _named(test, "RandomWalk", F.lit(0.0))


def fold_statistics(rows: DataFrame, feature: str, *keys: str) -> DataFrame:
    """Training mean of the label and population deviation of a feature."""
    return (rows.where((F.col("part") == "train") & F.col("target").isNotNull()
                       & F.col(feature).isNotNull())
            .groupBy(*keys, "fold_id").agg(F.avg("target").alias("train_mean"),
                                           F.stddev_pop(feature).alias("train_sd")))


def drift(test: DataFrame, stats: DataFrame, *keys: str) -> DataFrame:
    df = test.join(stats.select(*keys, "fold_id", "train_mean"), [*keys, "fold_id"])
    return _named(df, "Drift", F.col("train_mean")).drop("train_mean")


def momentum(test: DataFrame, stats: DataFrame, feature: str, *keys: str) -> DataFrame:
    df = test.join(stats.select(*keys, "fold_id", "train_sd"), [*keys, "fold_id"])
    scale = F.when(F.col("train_sd") == 0, 1.0).otherwise(F.col("train_sd"))
    return _named(df, "Momentum", F.signum(feature) * scale).drop("train_sd")


def equal_weight(test: DataFrame) -> DataFrame:
    return _named(test, "EqualWeight", F.lit(0.0))


def momentum_rank(test: DataFrame, feature: str = "mom_21d") -> DataFrame:
    return _named(test, "MomentumRank", F.col(feature))


def mean_reversion(test: DataFrame, feature: str = "ret_5d") -> DataFrame:
    return _named(test, "MeanReversion", -F.col(feature))


# ── labels and groups ───────────────────────────────────────────────────────
def relevance(rows: DataFrame, *keys: str) -> DataFrame:
    """Rank of the label within its date, 0 = worst; ties by asset."""
    ranked = row_rank(rows, [*keys, "date"], ["target", "asset"], "relevance")
    return ranked.withColumn("relevance", F.col("relevance") - 1)


def group_sizes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n_rows"))


# ── MLlib fits ──────────────────────────────────────────────────────────────
def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features",
                           handleInvalid="keep").transform(rows)


def elastic_net(alpha: float = 0.01, l1_ratio: float = 0.5, max_iter: int = 100) -> Fit:
    """Penalised linear model; columns are standardised on the training rows and
    coefficients come back in original units."""
    def fit(train: DataFrame, features: Sequence[str]):
        model = LinearRegression(featuresCol="_features", labelCol="target", regParam=alpha,
                                 elasticNetParam=l1_ratio, standardization=True,
                                 maxIter=max_iter).fit(assemble(train, features))

        def predict(rows: DataFrame) -> DataFrame:
            return model.transform(assemble(rows, features)).drop("_features").withColumnRenamed(
                "prediction", "pred")
        predict.model = model
        return predict
    return fit


def boosted_trees(label: str = "target", max_iter: int = 20, step: float = 0.1, depth: int = 5,
                  seed: int = 42) -> Fit:
    """Gradient-boosted regression, stopped early on the last dates of the
    training range behind an inner embargo."""
    def fit(train: DataFrame, features: Sequence[str]):
        axis = train.select("date").distinct().withColumn(
            "idx", F.row_number().over(Window.orderBy("date")) - 1)
        tail = time_tail(axis, min_val=10).where("part <> 'gap'").select(
            "date", (F.col("part") == "val").alias("is_val"))
        data = assemble(train.join(tail, "date"), features)
        gbt = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=max_iter, stepSize=step,
                           maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                           seed=seed, validationIndicatorCol="is_val")
        if data.where("is_val").limit(1).count() == 0:
            gbt.clear(gbt.validationIndicatorCol)
        model = gbt.fit(data)

        def predict(rows: DataFrame) -> DataFrame:
            return model.transform(assemble(rows, features)).drop("_features").withColumnRenamed(
                "prediction", "pred")
        predict.model = model
        return predict
    return fit


def quantile_trees(q: float = 0.9, spread: str = "vol_21d", buckets: int = 3, **kw) -> Fit:
    """Point forecast plus the q-quantile of residuals of rows as volatile as this
    one: training rows are cut at quantiles of ``spread``, and each bucket's
    quantile comes from the dates behind the inner embargo, which the early stop
    saw but no tree was grown on. A bucket without such dates takes all of them."""
    base = boosted_trees(**kw)

    def fit(train: DataFrame, features: Sequence[str]):
        point = base(train, features)
        by = spread if spread in features else features[0]
        cuts = train.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 10000)).first()[0] or []

        def bucket(c: str) -> Column:
            return sum(((F.col(c) > F.lit(v)).cast("int") for v in cuts), F.lit(0))
        axis = train.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
        tail = time_tail(axis, min_val=10).where("part = 'val'").select("date")
        held = train.join(tail, "date")
        if held.limit(1).count() == 0:
            held = train
        resid = point(held).select(bucket(by).alias("_b"), (F.col("target") - F.col("pred")).alias("e"))
        every = resid.agg(F.percentile_approx("e", q, 10000)).first()[0]
        shift = {r[0]: r[1] for r in resid.groupBy("_b").agg(F.percentile_approx("e", q, 10000)).collect()}
        shifts = F.array(*[F.lit(float(shift.get(b, every))) for b in range(buckets)])   # a few buckets

        def predict(rows: DataFrame) -> DataFrame:
            return point(rows).withColumn("pred", F.col("pred") + F.element_at(shifts, bucket(by) + 1))
        return predict
    return fit


def pairwise_linear(ridge: float = 1e-4) -> Fit:
    """Linear ranker minimising squared differences over all pairs of a date."""
    def fit(train: DataFrame, features: Sequence[str]):
        rows = relevance(train)
        means = rows.groupBy("date").agg(
            F.count(F.lit(1)).cast("double").alias("w"), F.avg("relevance").alias("_m"),
            *[F.avg(c).alias(f"_m_{c}") for c in features])
        centred = rows.join(means, "date").select(
            "w", (F.col("relevance") - F.col("_m")).alias("target"),
            *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in features])
        model = LinearRegression(featuresCol="_features", labelCol="target", weightCol="w",
                                 fitIntercept=False, regParam=ridge).fit(
            assemble(centred, features))

        def predict(rows: DataFrame) -> DataFrame:
            return model.transform(assemble(rows, features)).drop("_features").withColumnRenamed(
                "prediction", "pred")
        predict.model = model
        return predict
    return fit


def boosted_relevance(**kw) -> Fit:
    """Boosted trees on within-date relevance instead of the raw label."""
    base = boosted_trees(label="relevance", **kw)

    def fit(train: DataFrame, features: Sequence[str]):
        return base(relevance(train), features)
    return fit


def walk_forward(panel: DataFrame, axis: DataFrame, fold_rows: Sequence, features: Sequence[str],
                 fit: Fit, name: str) -> DataFrame:
    """Fit on each fold's training dates, predict its test dates. ``fold_rows``
    are the collected fold ranges (a handful of integers); panel rows are picked
    by index, finite ones only for training."""
    rows = panel.join(axis, "date")
    out = None
    for f in fold_rows:
        train = rows.where((F.col("idx") >= f.train_lo) & (F.col("idx") < f.train_hi)) \
            .dropna(subset=[*features, "target"])
        test = rows.where((F.col("idx") >= f.test_lo) & (F.col("idx") < f.test_hi))
        pred = fit(train, features)(test).select(
            F.lit(name).alias("run_id"), F.lit(f.fold_id).alias("fold_id"), "date", "asset",
            "pred", F.col("target").alias("realized"))
        out = pred if out is None else out.unionByName(pred)
    if out is None:
        raise ValueError("no folds: too few dates for the splitter")
    return out


def coefficients(predict, features: Sequence[str]) -> list[tuple[str, float]]:
    return [(c, float(v)) for c, v in zip(features, predict.model.coefficients)]


def score_latest(latest: DataFrame, predict, assets: Sequence[str]) -> DataFrame:
    """Predict scoring rows; ranked assets without a row get 0.0."""
    spark = latest.sparkSession
    want = spark.createDataFrame([(a,) for a in assets], "asset string")
    got = predict(latest).select("asset", "pred")
    return want.join(got, "asset", "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))


def null_features(latest: DataFrame, features: Sequence[str]) -> DataFrame:
    n = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return latest.select("asset", "date", n.alias("n_null"))
