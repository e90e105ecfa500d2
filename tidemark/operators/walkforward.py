"""Embargoed walk-forward folds as index ranges over the date axis."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS


@dataclass(frozen=True)
class Splitter:
    """First test row at ``min_train + embargo``; blocks of ``test_size``; the
    training range ends ``embargo`` rows before its test block."""

    min_train: int
    test_size: int
    embargo: int = 5
    n_splits: int | None = None
    train_window: int | None = None

    def __post_init__(self) -> None:
        if self.embargo < 0 or self.min_train < 1 or self.test_size < 1:
            raise ValueError(f"bad splitter sizes: {self}")

    @classmethod
    def from_years(cls, train_years: float, test_years: float, **kw) -> Splitter:
        return cls(int(train_years * TRADING_DAYS), int(test_years * TRADING_DAYS), **kw)

    def last(self, n: int) -> Splitter:
        return replace(self, n_splits=n)


def folds(counts: DataFrame, sp: Splitter, *keys: str) -> DataFrame:
    """Fold ranges (upper ends exclusive) from one row ``(*keys, n)`` per axis."""
    first = sp.min_train + sp.embargo
    n = F.col("n").cast("int")
    starts = F.when(n >= first + sp.test_size,
                    F.sequence(F.lit(first), n - sp.test_size, F.lit(sp.test_size)))
    df = counts.select(*keys, F.size(starts).alias("_all"), F.posexplode(starts))
    if sp.n_splits is not None:
        df = df.where(F.col("pos") >= F.col("_all") - sp.n_splits)
    train_hi = F.col("col") - sp.embargo
    lo = F.lit(0) if sp.train_window is None else F.greatest(F.lit(0), train_hi - sp.train_window)
    return df.select(*keys, F.col("pos").alias("fold_id"), lo.alias("train_lo"),
                     train_hi.alias("train_hi"), F.col("col").alias("test_lo"),
                     (F.col("col") + sp.test_size).alias("test_hi"))


def date_axis(panel: DataFrame, *keys: str) -> DataFrame:
    """Distinct dates per key, numbered from 0 (over dates, never over rows)."""
    w = Window.partitionBy(*keys).orderBy("date")
    return panel.select(*keys, "date").distinct().select(
        *keys, "date", (F.row_number().over(w) - 1).alias("idx"))


def axis_counts(axis: DataFrame, *keys: str) -> DataFrame:
    return axis.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def date_folds(axis: DataFrame, fold_table: DataFrame, *keys: str) -> DataFrame:
    """(*keys, date, idx, fold_id, part): every date once per fold range that
    holds it. Ranges meet dates as a short array per axis, so the range test is
    a filter on that array and not a nested-loop join."""
    ranges = fold_table.groupBy(*keys).agg(F.collect_list(F.struct(
        "fold_id", "train_lo", "train_hi", "test_lo", "test_hi")).alias("r"))
    if keys:
        df = axis.join(ranges, list(keys))
    else:
        df = axis.withColumn("r", ranges.scalar())
    hit = F.transform(F.col("r"), lambda f: F.struct(
        f["fold_id"].alias("fold_id"),
        F.when((F.col("idx") >= f["test_lo"]) & (F.col("idx") < f["test_hi"]), "test")
        .when((F.col("idx") >= f["train_lo"]) & (F.col("idx") < f["train_hi"]), "train")
        .alias("part")))
    hit = F.filter(hit, lambda x: x["part"].isNotNull())
    return df.select(*keys, "date", "idx", F.explode(hit).alias("f")).select(
        *keys, "date", "idx", "f.fold_id", "f.part")


def assign(panel: DataFrame, dates: DataFrame, *keys: str) -> DataFrame:
    """Attach folds to panel rows by date: all assets of a date move together."""
    return panel.join(dates, [*keys, "date"])


def train_sizes(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Usable training rows per fold; a fold with fewer than two is skipped.
    Test rows are never dropped here."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return (rows.where(F.col("part") == "train").groupBy(*keys, "fold_id")
            .agg(F.count_if(ok).alias("train_rows"))
            .withColumn("used", F.col("train_rows") >= 2))


def complete_dates(panel: DataFrame, columns: list[str], n_assets: int) -> DataFrame:
    """Dates on which all ``n_assets`` assets have every column."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return (panel.groupBy("date").agg(F.count_if(ok).alias("_ok"))
            .where(F.col("_ok") == n_assets).select("date"))


def time_tail(axis: DataFrame, *keys: str, min_val: int = 20, fraction: float = 0.15,
              embargo: int = 5, min_fit: int = 20) -> DataFrame:
    """Split an axis into fit / gap / val by its tail; all fit when too short.
    ``min_val`` is 20 for rows of one asset and 10 for dates of a panel."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    val_start = n - F.greatest(F.lit(min_val), F.floor(n * fraction))
    fit_end = val_start - embargo
    part = (F.when(fit_end < min_fit, "fit").when(F.col("idx") < fit_end, "fit")
            .when(F.col("idx") >= val_start, "val").otherwise("gap"))
    return axis.withColumn("part", part)


def oos_dates(dates: DataFrame, *keys: str) -> DataFrame:
    return dates.where(F.col("part") == "test").select(*keys, "date", "idx", "fold_id")


def audit_folds(dates: DataFrame, horizon: int, *keys: str) -> DataFrame:
    """Per fold: last training row, first test row, gap, and whether the gap
    covers the label horizon."""
    def edge(fn, part: str):
        return fn(F.when(F.col("part") == part, F.col("idx")))
    df = dates.groupBy(*keys, "fold_id").agg(edge(F.max, "train").alias("last_train"),
                                             edge(F.min, "test").alias("first_test"))
    gap = F.col("first_test") - F.col("last_train") - 1
    return df.withColumn("gap", gap).withColumn(
        "clean", F.col("last_train") + horizon < F.col("first_test"))
