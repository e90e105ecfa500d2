"""Per-series building blocks: returns, rolling statistics, alignment, labels.

Input is long, ``(asset, date, close)`` with one row per asset and date. Every
window here is one asset's history, whose length is the calendar, so one task
never holds more than a few thousand rows whatever the fact tables hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import (
    ANNUAL, TRADING_DAYS, by, clip, full_window, log_step, safe_corr, safe_div,
)

def hist():
    """Window over one asset's history (made late: it needs a session)."""
    return by("asset")


RETURN_LAGS = (1, 5, 10, 21)
VOL_WINDOWS = (5, 21)
MOM_WINDOWS = (10, 21)
MA_WINDOWS = (20, 60)


# ── own-history features ────────────────────────────────────────────────────
def log_returns(prices: DataFrame) -> DataFrame:
    return prices.withColumn("ret", log_step("close", 1, hist()))


def lagged_returns(prices: DataFrame, lags: Sequence[int] = RETURN_LAGS,
                   prefix: str = "") -> DataFrame:
    return prices.withColumns({f"{prefix}ret_{k}d": log_step("close", k, hist()) for k in lags})


def rolling_volatility(prices: DataFrame, windows: Sequence[int] = VOL_WINDOWS,
                       prefix: str = "", annualise: bool = True) -> DataFrame:
    scale = ANNUAL if annualise else 1.0
    df = prices.withColumn("_r", log_step("close", 1, hist()))
    return df.withColumns({
        f"{prefix}vol_{n}d": full_window(F.stddev_samp("_r"), "_r", hist(), n) * scale
        for n in windows}).drop("_r")


def rolling_momentum(prices: DataFrame, windows: Sequence[int] = MOM_WINDOWS,
                     prefix: str = "") -> DataFrame:
    df = prices.withColumn("_r", log_step("close", 1, hist()))
    return df.withColumns({f"{prefix}mom_{n}d": full_window(F.avg("_r"), "_r", hist(), n)
                           for n in windows}).drop("_r")


def distance_from_ma(prices: DataFrame, windows: Sequence[int] = MA_WINDOWS,
                     prefix: str = "") -> DataFrame:
    def dist(n: int) -> Column:
        ma = full_window(F.avg("close"), "close", hist(), n)
        return safe_div(F.col("close") - ma, ma)
    return prices.withColumns({f"{prefix}dist_ma_{n}": dist(n) for n in windows})


def own_features(prices: DataFrame) -> DataFrame:
    """The ten own columns; one sort by (asset, date) serves all of them."""
    df = lagged_returns(prices)
    df = df.withColumns({f"vol_{n}d": full_window(F.stddev_samp("ret_1d"), "ret_1d", hist(), n)
                         * ANNUAL for n in VOL_WINDOWS}
                        | {f"mom_{n}d": full_window(F.avg("ret_1d"), "ret_1d", hist(), n)
                           for n in MOM_WINDOWS})
    return distance_from_ma(df)


OWN_COLUMNS = ([f"ret_{k}d" for k in RETURN_LAGS] + [f"vol_{n}d" for n in VOL_WINDOWS]
               + [f"mom_{n}d" for n in MOM_WINDOWS] + [f"dist_ma_{n}" for n in MA_WINDOWS])


# ── calendars ───────────────────────────────────────────────────────────────
def trading_calendar(prices: DataFrame, ref_asset: str) -> DataFrame:
    """Dates of the reference asset, numbered from 0. The only window without a
    partition key; it runs over distinct dates, not over rows."""
    dates = prices.where(F.col("asset") == ref_asset).select("date").distinct()
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def every_date(keys: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per key and calendar date. The calendar enters as one array
    value (a scalar subquery), so no join takes place at all."""
    dates = calendar.agg(F.sort_array(F.collect_list("date")).alias("d")).scalar()
    return keys.select("*", F.explode(dates).alias("date"))


def on_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Closes at calendar dates, the last one carried over gaps without limit.
    Dates outside the calendar are dropped before carrying."""
    grid = every_date(prices.select("asset").distinct(), calendar)
    df = grid.join(prices.select("asset", "date", F.col("close").alias("_c")),
                   ["asset", "date"], "left")
    return df.select("asset", "date", F.last("_c", ignorenulls=True).over(hist()).alias("close"))


def pair_ratios(prices: DataFrame, calendar: DataFrame,
                pairs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(pair, date, ratio): log ratio of two closes on the calendar, each
    carried over its own gaps. ``pairs`` holds (numerator, denominator, name)."""
    pairs = list(pairs)
    legs = F.array(*[
        F.struct(F.lit(n).alias("pair"), F.lit(leg).alias("leg"), F.lit(t).alias("asset"))
        for a, b, n in pairs for leg, t in (("a", a), ("b", b))])
    used = sorted({t for a, b, _ in pairs for t in (a, b)})
    rows = (prices.where(F.col("asset").isin(used))
            .select("date", "close", F.explode(
                F.filter(legs, lambda x: x["asset"] == F.col("asset"))).alias("x"))
            .groupBy(F.col("x.pair").alias("pair"), "date")
            .agg(F.max(F.when(F.col("x.leg") == "a", F.col("close"))).alias("a"),
                 F.max(F.when(F.col("x.leg") == "b", F.col("close"))).alias("b")))
    w = by("pair")
    df = every_date(rows.select("pair").distinct(), calendar).join(rows, ["pair", "date"], "left")
    carried = [F.last(c, ignorenulls=True).over(w) for c in ("a", "b")]
    return df.select("pair", "date", F.log(safe_div(*carried)).alias("ratio"))


def context_returns(prices: DataFrame, targets: DataFrame, context: Sequence[str],
                    late: Iterable[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """1-step returns of context assets on each target's own dates. A context
    market that closes after the target's gets one more row of lag."""
    names = names or {}
    late = set(late)
    label = {t: names.get(t) or _safe(t) for t in context}
    wide = (prices.where(F.col("asset").isin(list(context))).groupBy("date")
            .agg(*[F.max(F.when(F.col("asset") == t, F.col("close"))).alias(f"_{label[t]}")
                   for t in context]))
    df = targets.join(wide, "date", "left")
    df = df.withColumns({f"_{label[t]}": F.last(f"_{label[t]}", ignorenulls=True).over(hist())
                         for t in context})
    df = df.withColumns({f"{label[t]}_ret_1d": log_step(f"_{label[t]}", 1, hist()) for t in context})
    delayed = [f"{label[t]}_ret_1d" for t in context if t in late]
    df = df.withColumns({c: F.lag(c, 1).over(hist()) for c in delayed}) if delayed else df
    return df.drop(*[f"_{label[t]}" for t in context])


def _safe(asset: str) -> str:
    return asset.translate({ord(c): None for c in "=^-"}).lower()


def price_features(prices: DataFrame, targets: Sequence[str], context: Sequence[str] = (),
                   late: Iterable[str] = (), names: dict[str, str] | None = None,
                   ratio: tuple[str, str, str] | None = None) -> DataFrame:
    """Own columns, context returns and optionally one pair ratio per target."""
    own = own_features(prices.where(F.col("asset").isin(list(targets)))
                       .select("asset", "date", "close"))
    df = context_returns(prices, own, context, late, names) if context else own
    if ratio is None:
        return df
    a, b, name = ratio
    legs = (prices.where(F.col("asset").isin(a, b)).groupBy("date")
            .agg(F.max(F.when(F.col("asset") == a, F.col("close"))).alias("_a"),
                 F.max(F.when(F.col("asset") == b, F.col("close"))).alias("_b")))
    carried = [F.last(c, ignorenulls=True).over(hist()) for c in ("_a", "_b")]
    return (df.join(legs, "date", "left")
            .withColumn(name, F.log(safe_div(*carried))).drop("_a", "_b"))


# ── slow series ─────────────────────────────────────────────────────────────
def align_to_calendar(raw: DataFrame, calendar: DataFrame, key: str = "series_id",
                      values: Sequence[str] = ("value",), limit: int = 5) -> DataFrame:
    """Carry each value over at most ``limit`` rows of the union of both date
    sets (null rows of the raw series count), then keep the calendar dates."""
    grid = every_date(raw.select(key).distinct(), calendar).select(
        key, "date", F.lit(1).alias("_cal"), *[F.lit(None).cast("double").alias(v) for v in values])
    rows = raw.select(key, "date", F.lit(0).alias("_cal"), *values)
    both = grid.unionByName(rows).groupBy(key, "date").agg(
        F.max("_cal").alias("_cal"), *[F.max(v).alias(v) for v in values])
    w = by(key)
    df = both.withColumn("_rn", F.row_number().over(w))

    def carried(v: str) -> Column:
        at = F.last(F.when(F.col(v).isNotNull(), F.col("_rn")), ignorenulls=True).over(w)
        return F.when(F.col("_rn") - at <= limit, F.last(v, ignorenulls=True).over(w)).alias(v)

    return (df.select(key, "date", "_cal", *[carried(v) for v in values])
            .where("_cal = 1").drop("_cal"))


def check_lag(lag: int) -> int:
    if lag < 1:
        raise ValueError(f"lag must be >= 1 so that a row sees only its past, got {lag}")
    return lag


def lag_series(df: DataFrame, lag: int = 1, key: str = "series_id",
               values: Sequence[str] = ("value",)) -> DataFrame:
    check_lag(lag)
    w = by(key)
    return df.withColumns({v: F.lag(v, lag).over(w) for v in values})


def difference(value: str, k: int, key: str = "series_id") -> Column:
    return F.col(value) - F.lag(value, k).over(by(key))


def zscore(value: str, n: int = 252, key: str = "series_id") -> Column:
    w = by(key)
    mean = full_window(F.avg(value), value, w, n)
    return safe_div(F.col(value) - mean, full_window(F.stddev_samp(value), value, w, n))


def macro_block(macro: DataFrame, calendar: DataFrame, level: dict[str, str],
                change_only: dict[str, str] | None = None,
                slope: tuple[str, str] | None = None, lag: int = 1) -> DataFrame:
    """Date-keyed macro columns: level and 1-day change per series, plus the
    long-short slope with its 21-row change and 252-row z-score."""
    change_only = change_only or {}
    used = {**level, **change_only} | ({} if slope is None else {s: s for s in slope})
    aligned = align_to_calendar(macro.where(F.col("series_id").isin(list(used))), calendar)
    df = lag_series(aligned, lag).withColumn("chg", difference("value", 1))

    def pick(series: str, col: str) -> Column:
        return F.max(F.when(F.col("series_id") == series, F.col(col)))

    cols = [c for s, p in level.items()
            for c in (pick(s, "value").alias(f"{p}_level"), pick(s, "chg").alias(f"{p}_chg_1d"))]
    cols += [pick(s, "chg").alias(f"{p}_chg_1d") for s, p in change_only.items()]
    if slope:
        cols.append((pick(slope[0], "value") - pick(slope[1], "value")).alias("slope"))
    out = df.groupBy("date").agg(*cols)
    if slope is None:
        return out
    # One row per calendar date; the constant key keeps a single ordered series.
    out = out.withColumn("_one", F.lit(1))
    return (out.withColumn("slope_chg_21d", difference("slope", 21, "_one"))
            .withColumn("slope_zscore", zscore("slope", 252, "_one")).drop("_one"))


# ── carry and positioning ───────────────────────────────────────────────────
def basis_momentum(closes: DataFrame) -> DataFrame:
    """ln(c_{t-21}/c_{t-252}): a year's momentum without its last month."""
    value = F.log(safe_div(F.lag("close", 21).over(hist()), F.lag("close", 252).over(hist())))
    return closes.withColumn("basis_momentum", value)


def carry_proxy(prices: DataFrame, calendar: DataFrame, pairs: dict[str, str],
                lag: int = 1) -> DataFrame:
    """(asset, date, carry_proxy): lagged log ratio of an asset to its pair."""
    check_lag(lag)
    ratios = pair_ratios(prices, calendar, [(a, b, a) for a, b in pairs.items()])
    return ratios.select(F.col("pair").alias("asset"), "date",
                         F.lag("ratio", lag).over(by("pair")).alias("carry_proxy"))


def date_mean(df: DataFrame, **means: str) -> DataFrame:
    """Null-safe cross-sectional means: partial sums per task, then one row per
    date. A date holding a third of all rows costs no more than any other."""
    return df.groupBy("date").agg(*[F.avg(v).alias(k) for k, v in means.items()])


def relative_to_basket(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``rel_<column>`` = value minus its mean over the basket at the date."""
    means = date_mean(df, **{f"_mean_{c}": c for c in columns})
    return (df.join(means, ["date"])
            .withColumns({f"rel_{c}": F.col(c) - F.col(f"_mean_{c}") for c in columns})
            .drop(*[f"_mean_{c}" for c in columns]))


def carry_block(prices: DataFrame, basket: Sequence[str], calendar: DataFrame,
                pairs: dict[str, str]) -> DataFrame:
    """Basis momentum and carry columns per basket asset and calendar date; an
    asset without a pair (or without prices) holds 0.0, never null."""
    known = prices.where(F.col("asset").isin(list(basket)))
    bm = relative_to_basket(basis_momentum(on_calendar(known, calendar)), ["basis_momentum"])
    names = F.explode(F.array(*[F.lit(a) for a in basket])).alias("asset")
    seed = calendar.select("date", names)
    present = known.select("asset").distinct().withColumn("_in", F.lit(True))
    df = (seed.join(bm.drop("close"), ["asset", "date"], "left").join(present, "asset", "left"))
    zero_if_absent = {c: F.when(F.col("_in"), F.col(c)).otherwise(F.lit(0.0))
                      for c in ("basis_momentum", "rel_basis_momentum")}
    df = df.withColumns(zero_if_absent).drop("_in")
    return with_carry(df, prices, basket, calendar, pairs) if pairs else df


CARRY_COLUMNS = ("carry_proxy", "carry_proxy_chg_21d", "rel_carry_proxy")


def with_carry(df: DataFrame, prices: DataFrame, basket: Sequence[str], calendar: DataFrame,
               pairs: dict[str, str]) -> DataFrame:
    """Join the carry columns; 0.0 for assets without a pair."""
    cp = carry_proxy(prices, calendar, pairs)
    cp = relative_to_basket(cp.where(F.col("asset").isin(list(basket))), ["carry_proxy"])
    cp = cp.withColumn("carry_proxy_chg_21d", difference("carry_proxy", 21, "asset"))
    paired = F.col("asset").isin(list(pairs))
    return df.join(cp, ["asset", "date"], "left").withColumns({
        c: F.when(paired, F.col(c)).otherwise(F.lit(0.0)) for c in CARRY_COLUMNS})


COT_COLUMNS = ("mm_net", "mm_net_chg", "mm_net_pct", "mm_long_ratio", "prod_net", "oi_chg_pct")


def range_position(value: str, w, n: int = 52, min_rows: int = 26) -> Column:
    """Place of a value in its trailing min-max range, 0..1; null when flat."""
    lo = full_window(F.min(value), value, w, n, min_rows)
    hi = full_window(F.max(value), value, w, n, min_rows)
    return clip(safe_div(F.col(value) - lo, F.nullif(hi - lo, F.lit(0.0))), 0.0, 1.0)


def positioning_weekly(cot: DataFrame) -> DataFrame:
    """Weekly derivations on release dates (column ``date``)."""
    w = by("asset")
    df = cot.withColumn("date", F.col("release_date"))
    df = df.withColumn("mm_net", F.col("mm_long") - F.col("mm_short"))
    return df.select(
        "asset", "date", "mm_net",
        difference("mm_net", 1, "asset").alias("mm_net_chg"),
        range_position("mm_net", w).alias("mm_net_pct"),
        safe_div("mm_long", F.nullif(F.col("mm_long") + F.col("mm_short"), F.lit(0.0)))
        .alias("mm_long_ratio"),
        (F.col("prod_long") - F.col("prod_short")).alias("prod_net"),
        (safe_div("oi", F.nullif(F.lag("oi", 1).over(w), F.lit(0.0))) - 1).alias("oi_chg_pct"))


def positioning_daily(cot: DataFrame, basket: Sequence[str], calendar: DataFrame,
                      lag: int = 1, limit: int = 10) -> DataFrame:
    """Weekly columns carried to the calendar (at most ``limit`` rows), then
    lagged. A basket asset without positioning data keeps a block of nulls."""
    weekly = positioning_weekly(cot.where(F.col("asset").isin(list(basket))))
    daily = lag_series(align_to_calendar(weekly, calendar, "asset", COT_COLUMNS, limit),
                       lag, "asset", COT_COLUMNS)
    seed = calendar.select("date", F.explode(F.array(*[F.lit(a) for a in basket])).alias("asset"))
    return seed.join(daily, ["asset", "date"], "left").select("asset", "date", *COT_COLUMNS)


def seasonal(df: DataFrame) -> DataFrame:
    angle = F.month("date") * (2.0 * 3.141592653589793 / 12.0)
    return df.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


# ── labels ──────────────────────────────────────────────────────────────────
def forward_log_return(prices: DataFrame, horizon: int = 1, name: str = "target") -> DataFrame:
    """ln(c_{t+h}/c_t) on the asset's own dates; a non-positive close on either
    side gives null (list such rows with ``non_positive_closes``)."""
    if horizon < 1:
        raise ValueError(f"horizon must be >= 1, got {horizon}")
    price = F.when(F.col("close") > 0, F.col("close"))
    ahead = F.lead(price, horizon).over(hist())
    return prices.withColumn(name, F.log(safe_div(ahead, price)))


def non_positive_closes(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("close") <= 0).select("asset", "date", "close")


def forward_return_asof(prices: DataFrame, asof: DataFrame, h: int = 5) -> DataFrame:
    """For each (asset, as_of): ln of the close h rows after the last close at or
    before that date. As-of rows are merged into the asset's own series and pick
    up the running row number, so no range join is needed."""
    w = by("asset")
    p = prices.where(F.col("close").isNotNull()).select("asset", "date", "close")
    p = p.withColumns({"i": F.row_number().over(w), "fwd": F.lead("close", h).over(w)})
    marks = asof.select("asset", F.col("as_of").alias("date")).distinct().select(
        "asset", "date", F.lit(None).cast("double").alias("close"),
        F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("fwd"),
        F.lit(1).alias("mark"))
    both = p.withColumn("mark", F.lit(0)).unionByName(marks)
    prior = Window.partitionBy("asset").orderBy("date", "mark").rowsBetween(
        Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("mark") == 0, F.struct("close", "fwd", "date")),
                ignorenulls=True).over(prior)
    return (both.withColumn("at", at).where("mark = 1")
            .select("asset", F.col("date").alias("as_of"), F.col("at.date").alias("price_date"),
                    F.log(safe_div("at.fwd", "at.close")).alias("fwd_ret")))


def business_days(prices: DataFrame) -> DataFrame:
    """Drop weekend rows of an asset quoted on seven days, before any return."""
    return prices.where(~F.dayofweek("date").isin(1, 7))


# ── volatility ──────────────────────────────────────────────────────────────
EWMA_BLOCK = 2048


def ewma_block(lam: float) -> int:
    """Rows per block: few enough that lam^-rows stays far inside the range of a
    double."""
    return max(1, min(EWMA_BLOCK, int(250 * math.log(10) / -math.log(lam))))


def ewma_vol(returns: DataFrame, lam: float = 0.94, annual: float = TRADING_DAYS) -> DataFrame:
    """One-step EWMA volatility forecast from (asset, date, ret), ret non-null.

    The recursion s_t = lam*s_{t-1} + (1-lam)*r_{t-1}^2 with s_1 = r_0^2 is a
    discounted prefix sum. It is taken within blocks of rows, so that lam^-i
    stays in range; the state at a block's start is folded over the ends of all
    blocks before it, one number per block of an asset."""
    if not 0 < lam < 1:
        raise ValueError(f"lam must be in (0, 1), got {lam}")
    block = ewma_block(lam)
    i = F.row_number().over(hist()) - 1
    df = returns.withColumn("_i", i)
    df = df.withColumns({"_b": F.floor(F.col("_i") / block), "_k": F.col("_i") % block})
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(1.0 - lam)
    term = F.col("ret") * F.col("ret") * weight * F.pow(F.lit(lam), -F.col("_k"))
    wb = Window.partitionBy("asset", "_b").orderBy("date")
    df = df.withColumn("_t", term)
    before = F.coalesce(F.sum("_t").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_own", before * F.pow(F.lit(lam), F.col("_k") - 1))
    ends = df.groupBy("asset", "_b").agg(
        (F.sum("_t") * F.pow(F.lit(lam), F.lit(float(block - 1)))).alias("_end"))
    step = lam ** block
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_b", "_end"))), lambda x: x["_end"])
    carries = F.aggregate(ordered, F.array(F.lit(0.0)), lambda acc, end: F.concat(
        acc, F.array(F.element_at(acc, -1) * F.lit(step) + end)))
    carry = ends.groupBy("asset").agg(carries.alias("_c")).select(
        "asset", F.posexplode("_c").alias("_b", "_carry"))
    s2 = F.col("_own") + F.col("_carry") * F.pow(F.lit(lam), F.col("_k").cast("double"))
    out = df.join(carry, ["asset", "_b"])
    return (out.withColumn("ewma_vol", F.when(F.col("_i") > 0, F.sqrt(s2 * annual)))
            .drop("_i", "_b", "_k", "_t", "_own", "_carry"))


def realized_vol(returns: DataFrame, window: int = 21) -> DataFrame:
    need = max(5, window // 2)
    value = full_window(F.stddev_samp("ret"), "ret", hist(), window, need) * ANNUAL
    return returns.withColumn("realized_vol", value)


def vol_forecast_corr(df: DataFrame, forecast: str, realized: str = "realized_vol",
                      min_rows: int = 30) -> DataFrame:
    """Per asset correlation of forecast and realized volatility."""
    both = df.where(F.col(forecast).isNotNull() & F.col(realized).isNotNull())
    return both.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_rows, safe_corr(forecast, realized)).alias("vol_corr"))


GARCH_GRID = tuple((a, b) for a in (0.03, 0.05, 0.08, 0.12, 0.2)
                   for b in (0.6, 0.7, 0.8, 0.85, 0.9, 0.94) if a + b < 0.995)


def garch_vol(returns: DataFrame, min_train: int = 250, refit_every: int = 63,
              grid: Sequence[tuple[float, float]] = GARCH_GRID) -> DataFrame:
    """GARCH(1,1) one-step forecasts, refitted every ``refit_every`` rows.

    Spark splits the work by asset; a task runs the variance recursion of one
    asset's history once, with all grid points side by side. At each refit the
    point with the best likelihood on the past is taken, its omega targeted to
    the past variance."""
    def one_asset(pdf: pd.DataFrame) -> pd.DataFrame:
        return _garch_path(pdf.sort_values("date"), min_train, refit_every, grid)

    return (returns.select("asset", "date", "ret").where(F.col("ret").isNotNull())
            .groupBy("asset").applyInPandas(
                one_asset, "asset string, date date, alpha double, beta double, garch_vol double"))


def fitted_garch_vol(returns: DataFrame, min_train: int = 250, refit_every: int = 63,
                     grid: Sequence[tuple[float, float]] = GARCH_GRID) -> DataFrame:
    """GARCH(1,1) one-step forecasts whose omega, alpha and beta maximise the past
    likelihood at each refit: a pattern search from the better of the last fit and the
    best grid point. ``log_lik`` and ``grid_log_lik`` (omega targeted) belong to the
    refit in force. Spark splits the work by asset."""
    def one_asset(pdf: pd.DataFrame) -> pd.DataFrame:
        return _garch_search(pdf.sort_values("date"), min_train, refit_every, grid)

    return (returns.select("asset", "date", "ret").where(F.col("ret").isNotNull()).groupBy("asset").applyInPandas(
        one_asset, "asset string, date date, omega double, alpha double, beta double, garch_vol double, "
                   "log_lik double, grid_log_lik double"))


def _likelihoods(r2, points):
    """Gaussian log likelihoods (twice, without constants) of (omega, alpha, beta)
    rows on squared returns, and the variance each expects next."""
    import numpy as np
    omega, alpha, beta = points.T
    s2 = np.full(len(points), r2.mean())
    ll = np.zeros(len(points))
    for v in r2:
        ll -= np.log(s2) + v / s2
        s2 = omega + alpha * v + beta * s2
    return ll, s2


def _garch_search(pdf: pd.DataFrame, min_train: int, refit_every: int, grid) -> pd.DataFrame:
    import numpy as np
    r2 = (pdf["ret"].to_numpy() * 100.0) ** 2
    n = len(r2)
    out = np.full((n, 6), np.nan)
    moves = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], dtype=float)
    last = None
    for start in range(min_train, n, refit_every):
        past = r2[:start]
        coarse = np.array([(past.mean() * (1 - a - b), a, b) for a, b in grid])
        ll, _ = _likelihoods(past, coarse)
        best, grid_ll = coarse[ll.argmax()], ll.max()
        if last is not None and _likelihoods(past, last[None])[0][0] > grid_ll:
            best = last
        step = np.array([0.4, 0.04, 0.04])
        for _ in range(30):
            tried = np.column_stack([best[0] * np.exp(moves[:, 0] * step[0]), best[1] + moves[:, 1] * step[1],
                                     best[2] + moves[:, 2] * step[2]])
            tried[:, 1:] = np.clip(tried[:, 1:], 1e-6, 0.999)
            tried = np.vstack([best[None], tried[tried[:, 1] + tried[:, 2] < 0.9995]])
            ll, ahead = _likelihoods(past, tried)
            at = ll.argmax()
            if ll[at] <= ll[0] + 1e-9:
                step /= 3
                if step[1] < 1e-4:
                    break
            best = tried[at]
        ll, ahead = _likelihoods(past, best[None])
        last, state = best, ahead[0]
        for t in range(start, min(start + refit_every, n)):
            out[t] = (*best, np.sqrt(state * TRADING_DAYS) / 100.0, ll[0], grid_ll)
            state = best[0] + best[1] * r2[t] + best[2] * state
    return pd.DataFrame({"asset": pdf["asset"], "date": pdf["date"], **dict(zip(
        ("omega", "alpha", "beta", "garch_vol", "log_lik", "grid_log_lik"), out.T))})


def _garch_path(pdf: pd.DataFrame, min_train: int, refit_every: int, grid) -> pd.DataFrame:
    import numpy as np
    r2 = (pdf["ret"].to_numpy() * 100.0) ** 2
    n = len(r2)
    vol, pa, pb = (np.full(n, np.nan) for _ in range(3))
    starts = np.arange(min_train, n, refit_every)
    if len(starts):
        alpha, beta = (np.array(x) for x in zip(*grid))
        target = (np.cumsum(r2) / np.arange(1, n + 1))[starts - 1][:, None]
        omega = target * (1 - alpha - beta)
        s2 = np.repeat(target, len(alpha), axis=1)
        ll = np.zeros_like(s2)
        for t in range(starts[-1]):            # rows before a refit feed only later refits
            live = slice(np.searchsorted(starts, t, side="right"), None)
            ll[live] -= np.log(s2[live]) + r2[t] / s2[live]
            s2[live] = omega[live] + alpha * r2[t] + beta * s2[live]
        best = ll.argmax(axis=1)
        for k, start in enumerate(starts):
            g = best[k]
            state = s2[k, g]
            for t in range(start, min(start + refit_every, n)):
                vol[t] = np.sqrt(state * TRADING_DAYS) / 100.0
                pa[t], pb[t] = alpha[g], beta[g]
                state = omega[k, g] + alpha[g] * r2[t] + beta[g] * state
    return pd.DataFrame({"asset": pdf["asset"], "date": pdf["date"],
                         "alpha": pa, "beta": pb, "garch_vol": vol})
