"""Exact ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import cut_lineage


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null meets null."""
    renamed = other.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return df.join(renamed, on).drop(*[f"_r{i}" for i in range(len(keys))])


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Cut rows into ranges of (keys, order). The cut is durable: range numbers must
    not change under a later recomputation."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def _shifts(ranged: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Per group and range, the size of the group's earlier ranges: one row per
    group and task."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.groupBy(*keys, "_part").agg(size.alias("_size")).select(
        *keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add 1-based ranks of ``value`` within ``keys``; ties share their mean rank.
    Null keys form a group and null values rank first, as in a window.

    Ranks come from value counts: one row per distinct value (a value shared by a
    third of all rows becomes one row map-side), cut into ranges, numbered within
    each range and shifted by the ranges before it. No task holds a group."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = _ranged(counts, keys, [F.col(value)])
    upto = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("_upto", F.sum("_n").over(upto))
    below = F.col("_shift") + F.col("_upto") - F.col("_n")
    ranks = null_safe_join(inside, _shifts(ranged, keys, F.sum("_n")), [*keys, "_part"]).select(
        *keys, value, (below + (F.col("_n") + 1) / 2).alias(out))
    return null_safe_join(df, ranks, [*keys, value])


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """1-based row numbers by ``order`` columns within ``keys``, by ranges: rows are
    cut once and numbered where they are."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _ranged(df, keys, order)
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    shifts = _shifts(ranged, keys, F.count(F.lit(1)))
    return (null_safe_join(inside, shifts, [*keys, "_part"])
            .withColumn(out, (F.col("_shift") + F.col("_at")).cast("int")).drop("_part", "_at", "_shift"))


def extremes(df: DataFrame, keys: Sequence[str], value: str, tie: str,
             n_high: int, n_low: int) -> DataFrame:
    """The top and bottom rows per group with ``side`` +1 / -1. The row-number
    filters become group limits ahead of the shuffle: each task forwards at most
    n rows per group, however large the group is."""
    hi = Window.partitionBy(*keys).orderBy(F.desc(value), F.desc(tie))
    lo = Window.partitionBy(*keys).orderBy(F.asc(value), F.asc(tie))
    top = df.withColumn("_rn", F.row_number().over(hi)).where(F.col("_rn") <= n_high)
    low = df.withColumn("_rn", F.row_number().over(lo)).where(F.col("_rn") <= n_low)
    return (top.withColumn("side", F.lit(1.0)).unionByName(low.withColumn("side", F.lit(-1.0)))
            .drop("_rn"))
