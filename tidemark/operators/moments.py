"""Training statistics of folds from moments, without copying a row.

The ends of all training ranges cut a date axis into segments. Rows are summed once
per segment; a fold's statistics are the sums of the segments inside its range. The
plan holds one partial aggregation over rows whatever the number of folds, and
everything after it has folds and segments for rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import safe_div


def fold_moments(rows: DataFrame, fold_table: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(*keys, fold_id, n, m): rows of each training range on which no column is null,
    with the sums of ``columns`` and of their products, the upper triangle by rows.
    ``rows`` carry ``idx``, their place on the axis of their key."""
    if not keys:                                                               # one axis: a constant for its key
        one = fold_moments(rows.withColumn("_axis", F.lit(0)), fold_table.withColumn("_axis", F.lit(0)), columns, "_axis")
        return one.drop("_axis")
    keys = list(keys)
    cuts = fold_table.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.array("train_lo", "train_hi"))))).alias("cuts"))                      # two numbers a fold
    complete = rows.dropna(subset=list(columns))
    cut = complete.join(cuts, keys).withColumn("seg", F.size(F.filter("cuts", lambda c: c <= F.col("idx"))))
    products = [F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = cut.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("n"), F.array(
        *[F.sum(c) for c in columns], *[F.sum(p) for p in products]).alias("m"))
    parts = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg", "n", "m"))).alias("parts"))
    f = fold_table.join(cuts.join(parts, keys), keys)
    inside = F.filter("parts", lambda p: (p["seg"] >= F.array_position("cuts", F.col("train_lo")))
                      & (p["seg"] < F.array_position("cuts", F.col("train_hi"))))
    width = len(columns) + len(products)
    added = F.aggregate(inside, F.array_repeat(F.lit(0.0), width),
                        lambda acc, p: F.zip_with(acc, p["m"], lambda a, b: a + b))
    return f.select(*keys, "fold_id", F.aggregate(inside, F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n"),
                    added.alias("m"))


def _place(i: int, j: int, width: int) -> int:
    """1-based place of the product of columns i <= j in the array of moments."""
    return width + i * width - i * (i - 1) // 2 + (j - i) + 1


def mean_of(i: int) -> Column:
    return safe_div(F.element_at("m", i + 1), "n")


def covariance_of(i: int, j: int, width: int) -> Column:
    i, j = min(i, j), max(i, j)
    return safe_div(F.element_at("m", _place(i, j, width)), "n") - mean_of(i) * mean_of(j)


def deviation_of(i: int, width: int) -> Column:
    """Population deviation; a spread within rounding of the mean square is zero."""
    square = safe_div(F.element_at("m", _place(i, i, width)), "n")
    v = covariance_of(i, i, width)
    return F.when(v <= 1e-14 * square, 0.0).otherwise(F.sqrt(v))


def fold_statistics(rows: DataFrame, fold_table: DataFrame, feature: str, *keys: str) -> DataFrame:
    """Training mean of the label and population deviation of a feature per fold."""
    m = fold_moments(rows, fold_table, ["target", feature], *keys)
    return m.select(*keys, "fold_id", F.col("n").alias("train_rows"), mean_of(0).alias("train_mean"),
                    deviation_of(1, 2).alias("train_sd"))


def elastic_net(moments: DataFrame, n_features: int, alpha: float = 0.01, l1_ratio: float = 0.5, sweeps: int = 60) -> DataFrame:
    """Adds ``coef`` and ``intercept``, in original units, to moments whose last column
    is the label: coordinate descent on standardised covariances, for every model at
    once. A constant column keeps scale 1 and gets no weight. The objective is half
    the mean squared error plus alpha times (l1_ratio |w| + (1 - l1_ratio) w^2 / 2)."""
    k, width = n_features, n_features + 1
    sd = F.array(*[F.when(deviation_of(i, width) == 0, 1.0).otherwise(deviation_of(i, width)) for i in range(k)])
    df = moments.withColumn("_sd", sd)
    at = lambda i: F.element_at("_sd", i + 1)
    gram = F.array(*[F.array(*[safe_div(covariance_of(i, j, width), at(i) * at(j)) for j in range(k)]) for i in range(k)])
    pull = F.array(*[safe_div(covariance_of(i, k, width), at(i)) for i in range(k)])
    df = df.withColumn("_c", gram).withColumn("_g", pull)

    def step(w: Column, s: Column) -> Column:
        j = s % k + 1
        row, own = F.element_at("_c", j), F.element_at(w, j)
        met = F.aggregate(F.zip_with(row, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rest = F.element_at("_g", j) - met + F.element_at(row, j) * own
        soft = F.signum(rest) * F.greatest(F.abs(rest) - alpha * l1_ratio, F.lit(0.0))
        new = soft / (F.element_at(row, j) + alpha * (1 - l1_ratio))
        return F.transform(w, lambda v, i: F.when(i == j - 1, new).otherwise(v))
    w = F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * k - 1)), F.array_repeat(F.lit(0.0), k), step)
    df = df.withColumn("_w", w).withColumn("coef", F.zip_with("_w", "_sd", lambda a, b: a / b))
    means = F.array(*[mean_of(i) for i in range(k)])
    intercept = mean_of(k) - F.aggregate(F.zip_with("coef", means, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("intercept", intercept).drop("_sd", "_c", "_g", "_w")


def linear_prediction(features: Sequence[str]) -> Column:
    parts = F.zip_with("coef", F.array(*features), lambda a, b: a * b)
    return F.col("intercept") + F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
