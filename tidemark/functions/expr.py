"""Column expressions shared by every operator.

All of them are built-in Spark functions, so they stay inside code generation,
and none depends on a session setting: ANSI mode raises on x/0, hence
``try_divide`` throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADING_DAYS = 252
ANNUAL = math.sqrt(TRADING_DAYS)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by(*keys: str, order: str = "date") -> WindowSpec:
    """Ordered window of one series. A series holds one row per date, so the
    window is bounded by the calendar, never by the size of the raw data."""
    return Window.partitionBy(*keys).orderBy(order)


def safe_div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a), _c(b))


def log_step(value: Column | str, k: int, w: WindowSpec) -> Column:
    """ln(v_t / v_{t-k}); null where either side is absent or not positive."""
    return F.log(safe_div(value, F.lag(_c(value), k).over(w)))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full_window(agg: Column, value: Column | str, w: WindowSpec, n: int,
                min_count: int | None = None) -> Column:
    """``agg`` over the last n rows, null unless enough of them hold a value."""
    frame = trailing(w, n)
    need = n if min_count is None else min_count
    return F.when(F.count(_c(value)).over(frame) >= need, agg.over(frame))


def safe_corr(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation from moments over pairwise complete rows; null when a
    side is constant (the built-in raises DIVIDE_BY_ZERO there under ANSI)."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)

    def run(c: Column) -> Column:
        return c.over(over) if over is not None else c

    return F.try_divide(run(F.covar_pop(px, py)),
                        run(F.stddev_pop(px)) * run(F.stddev_pop(py)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def col_safe(asset: Column | str) -> Column:
    """Asset label usable as a column name."""
    return F.lower(F.translate(_c(asset), "=^-", ""))


def n_long_short(n: Column) -> Column:
    """Legs per side by universe size."""
    return F.when(n >= 9, 3).when(n >= 6, 2).otherwise(1)


def n_long_short_of(n: int) -> int:
    return 3 if n >= 9 else 2 if n >= 6 else 1


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Project ``names`` with every double rounded (and -0.0 made 0.0)."""
    names = names or tuple(df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (F.round(F.col(n), digits) + F.lit(0.0)).alias(n)
        if isinstance(kinds[n], T.DoubleType) else F.col(n)
        for n in names])


def significant(df: DataFrame, *names: str) -> DataFrame:
    """Ten significant digits for columns whose scale varies, such as compounded
    curves."""
    return df.withColumns({n: F.format_string("%.9e", n).cast("double") for n in names})
