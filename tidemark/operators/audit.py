"""Leakage audits as jobs: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truncation_diff(data: DataFrame, build: Callable[[DataFrame], DataFrame], cut: str,
                    keys: Sequence[str], columns: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Rebuild features on data up to ``cut``: values on shared dates must not
    change. One row per column: rows compared, rows that differ."""
    upto = F.col("date") <= F.lit(cut).cast("date")
    full, short = build(data).where(upto), build(data.where(upto))
    a = full.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = short.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, list(keys), "full")

    def differs(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return (x.isNull() != y.isNull()) | (F.abs(x - y) > tol)
    stats = both.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.count_if(differs(c)).alias(c) for c in columns])
    return stats.unpivot("n_rows", list(columns), "column", "n_diff")


def release_violations(cot: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """Per asset: trading days whose lagged positioning row was released on or
    after that day (must be 0), and days checked."""
    from tidemark.operators.timeseries import align_to_calendar, lag_series
    raw = cot.select("asset", F.col("release_date").alias("date"),
                     F.unix_date("release_date").cast("double").alias("value"))
    daily = lag_series(align_to_calendar(raw, calendar, "asset", ("value",), 10), lag, "asset")
    seen = daily.where(F.col("value").isNotNull())
    return seen.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("value") >= F.unix_date("date")).alias("n_late"))


def basket_sums(relative: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum of relative features over the basket per date (zero by construction)."""
    return relative.groupBy("date").agg(*[F.sum(c).alias(c) for c in columns])


def fold_integrity(rows: DataFrame, n_assets: int) -> DataFrame:
    """Dates of a fold that are both train and test or lack assets."""
    per = rows.groupBy("fold_id", "date").agg(
        F.countDistinct("part").alias("n_parts"), F.countDistinct("asset").alias("n_assets"))
    return per.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("n_parts") > 1).alias("n_mixed"),
        F.count_if(F.col("n_assets") != n_assets).alias("n_short"))


def label_overlap(dates: DataFrame, horizon: int) -> DataFrame:
    """Training rows whose label reaches into the test block, per fold."""
    edge = dates.groupBy("fold_id").agg(
        F.min(F.when(F.col("part") == "test", F.col("idx"))).alias("first_test"))
    j = dates.where("part = 'train'").join(edge, "fold_id")
    return j.groupBy("fold_id").agg(
        F.count_if(F.col("idx") + horizon >= F.col("first_test")).alias("n_overlap"))
