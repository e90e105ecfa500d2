"""Information coefficients, strategy statistics and comparison tables.

Every measure is a grouped aggregate with map-side partial sums. Running
products and drawdowns are windows over one run's dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS, by, safe_corr, safe_div
from tidemark.functions.ranks import average_rank, row_rank

TINY = 1e-12


def pairs(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("pred").isNotNull() & F.col("realized").isNotNull())


def ic(preds: DataFrame, *keys: str, min_rows: int = 3) -> DataFrame:
    return pairs(preds).groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= min_rows, safe_corr("pred", "realized")).alias("ic"))


def ranked_pairs(preds: DataFrame, *keys: str) -> DataFrame:
    df = pairs(preds)
    df = average_rank(df, keys, "pred", "rank_pred")
    return average_rank(df, keys, "realized", "rank_real")


def rank_ic(preds: DataFrame, *keys: str, min_rows: int = 3, flat: float = 0.0) -> DataFrame:
    """Spearman correlation with mean ranks for ties; null below ``min_rows``
    or when a side's standard deviation is at most ``flat``. Rounded to 12 digits:
    a coefficient of exactly 0 must not turn positive by summation order."""
    moving = (F.stddev_pop("pred") > flat) & (F.stddev_pop("realized") > flat)
    return ranked_pairs(preds, *keys).groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) >= min_rows) & moving,
               F.round(safe_corr("rank_pred", "rank_real"), 12)).alias("rank_ic"))


def directional_accuracy(preds: DataFrame, *keys: str) -> DataFrame:
    same = (F.signum("pred") == F.signum("realized")).cast("double")
    return pairs(preds).groupBy(*keys).agg(
        F.avg(F.when(F.col("pred") != 0, same)).alias("hit_rate"))


def cs_ric(preds: DataFrame) -> DataFrame:
    """Cross-sectional rank IC per run and date."""
    return rank_ic(preds, "run_id", "date", min_rows=2, flat=TINY).withColumnRenamed(
        "rank_ic", "cs_ric")


def cs_ric_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("run_id").agg(
        F.avg("cs_ric").alias("mean_cs_ric"), F.stddev_samp("cs_ric").alias("std_cs_ric"),
        F.avg((F.col("cs_ric") > 0).cast("double")).alias("cs_ric_stability"))


def every_hth(pnl: DataFrame, horizon: int, drop_null_first: bool = True) -> DataFrame:
    """Rows 0, h, 2h … of each run; a panel drops null rows before counting, a
    single series after."""
    df = pnl.where(F.col("net").isNotNull()) if drop_null_first else pnl
    df = df.withColumn("_rn", F.row_number().over(by("run_id")) - 1)
    return df.where((F.col("_rn") % horizon == 0) & F.col("net").isNotNull()).drop("_rn")


def sharpe_stats(pnl: DataFrame, horizon: int, drop_null_first: bool = True) -> DataFrame:
    """Annualised return, volatility, Sharpe and worst drawdown per run."""
    df = every_hth(pnl, horizon, drop_null_first)
    upto = by("run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_curve", F.product(1.0 + F.col("net")).over(upto))
    df = df.withColumn("_dd", safe_div("_curve", F.max("_curve").over(upto)) - 1.0)
    ppy = TRADING_DAYS / horizon
    out = df.groupBy("run_id").agg((F.avg("net") * ppy).alias("ann_return"),
                                   (F.stddev_pop("net") * ppy ** 0.5).alias("ann_vol"),
                                   F.min("_dd").alias("max_drawdown"))
    sharpe = F.when(F.col("ann_vol") > TINY, F.col("ann_return") / F.col("ann_vol"))
    return out.withColumn("sharpe", sharpe)


def strategy_stats(pnl: DataFrame, horizon: int) -> DataFrame:
    """Single-series statistics: Sharpe block, full-series turnover, hit rate."""
    turn = pnl.groupBy("run_id").agg(F.avg("turnover").alias("turnover"))
    return (sharpe_stats(pnl, horizon, drop_null_first=False).join(turn, "run_id")
            .join(directional_accuracy(pnl, "run_id"), "run_id", "left"))


def fold_metrics(preds: DataFrame, *keys: str) -> DataFrame:
    keys = (*keys, "fold_id")
    size = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("test_rows"))
    return (size.join(ic(preds, *keys), list(keys), "left")
            .join(rank_ic(preds, *keys), list(keys), "left")
            .join(directional_accuracy(preds, *keys), list(keys), "left"))


def run_metrics(preds: DataFrame, folds: DataFrame) -> DataFrame:
    """Pooled coefficients over the whole run and means over folds."""
    per_fold = folds.groupBy("run_id").agg(
        F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg("hit_rate").alias("mean_hit_rate"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_stability"))
    return (ic(preds, "run_id").withColumnRenamed("ic", "pooled_ic")
            .join(rank_ic(preds, "run_id").withColumnRenamed("rank_ic", "pooled_rank_ic"),
                  "run_id", "full").join(per_fold, "run_id", "full"))


def _rounded(col: str, digits: int) -> Column:
    return (F.round(F.col(col), digits) + F.lit(0.0)).alias(col)


def comparison_table(runs: DataFrame, stats: DataFrame) -> DataFrame:
    return runs.join(stats, "run_id", "full").select(
        "run_id", *[_rounded(c, 4) for c in ("pooled_ic", "pooled_rank_ic", "mean_ic")],
        _rounded("ic_stability", 2), _rounded("sharpe", 2),
        *[_rounded(c, 3) for c in ("ann_return", "max_drawdown", "turnover", "hit_rate")])


def ranking_table(ric: DataFrame, stats: DataFrame, capture: DataFrame, turnover: DataFrame,
                  n_folds: DataFrame) -> DataFrame:
    df = n_folds
    for other in (ric, stats, capture, turnover):
        df = df.join(other, "run_id", "left")
    return df.select("run_id", "n_folds", _rounded("mean_cs_ric", 4), _rounded("std_cs_ric", 4),
                     _rounded("cs_ric_stability", 3), _rounded("sharpe", 2),
                     *[_rounded(c, 3) for c in ("ann_return", "max_drawdown", "capture",
                                                "turnover")])


def rolling_ic(preds: DataFrame, window: int = 63, min_rows: int = 31) -> DataFrame:
    """Trailing Pearson IC of each run; constant-prediction runs left out, and
    windows in which a side does not move give null."""
    varied = (preds.groupBy("run_id").agg(F.stddev_pop("pred").alias("_sd"))
              .where(F.col("_sd") >= TINY).select("run_id"))
    df = preds.join(varied, "run_id", "left_semi")
    frame = by("run_id").rowsBetween(-(window - 1), Window.currentRow)
    both = F.count(F.when(F.col("pred").isNotNull() & F.col("realized").isNotNull(), 1))
    moving = ((F.stddev_pop("pred").over(frame) >= TINY)
              & (F.stddev_pop("realized").over(frame) >= TINY))
    value = F.when((both.over(frame) >= min_rows) & moving, safe_corr("pred", "realized", frame))
    return df.withColumn("rolling_ic", value)


def fold_dates(preds: DataFrame, *keys: str) -> DataFrame:
    return preds.groupBy(*keys, "fold_id").agg(F.min("date").alias("first_date"),
                                               F.max("date").alias("last_date"))


LEAK_IC, LEAK_SHARPE, LEAK_CS_RIC, EDGE_STABILITY = 0.05, 2.5, 0.15, 0.5
BASELINES = ("RandomWalk", "Drift", "Momentum")


def verdict(table: DataFrame) -> DataFrame:
    """Leakage / edge / none per (series, model); an edge beats Drift's Sharpe
    with a stable IC and is no baseline itself."""
    drift = table.where(F.col("model") == "Drift").select(
        "series", F.col("sharpe").alias("drift_sharpe"))
    leak = (F.abs("pooled_ic") > LEAK_IC) | (F.col("sharpe") > LEAK_SHARPE)
    edge = ((F.col("sharpe") > F.col("drift_sharpe")) & (F.col("ic_stability") > EDGE_STABILITY)
            & ~F.col("model").isin(*BASELINES))
    return table.join(drift, "series", "left").withColumn(
        "verdict", F.when(leak, "leakage").when(edge, "edge").otherwise("none"))


def leakage_flags(table: DataFrame) -> DataFrame:
    ric = table.where(F.abs("mean_cs_ric") > LEAK_CS_RIC).select(
        "run_id", F.lit("cs_ric").alias("flag"), F.col("mean_cs_ric").alias("value"))
    sharpe = table.where(F.col("sharpe") > LEAK_SHARPE).select(
        "run_id", F.lit("sharpe").alias("flag"), F.col("sharpe").alias("value"))
    return ric.unionByName(sharpe)


def sweep_matrix(table: DataFrame, value: str, horizons: Sequence[int] = (5, 21, 63)) -> DataFrame:
    out = table.groupBy("model").pivot("horizon", list(horizons)).agg(F.first(value))
    return out.select("model", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def best_config(table: DataFrame) -> DataFrame:
    ok = table.where(F.col("sharpe").isNotNull())
    return ok.agg(F.max_by(F.struct("model", "horizon", "sharpe"),
                           F.struct("sharpe", "model", "horizon")).alias("b")).select("b.*")


def blend_sweep(pnl: DataFrame, first: str, second: str, weights: Sequence[float],
                every: int = 63) -> DataFrame:
    """Blend two profit series over common dates at several weights: Sharpe on
    all rows and on every n-th row, return and drawdown."""
    legs = (pnl.where(F.col("run_id").isin(first, second)).groupBy("date")
            .agg(F.max(F.when(F.col("run_id") == first, F.col("net"))).alias("a"),
                 F.max(F.when(F.col("run_id") == second, F.col("net"))).alias("b"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("w")
    mix = legs.select("date", "a", "b", w).select(
        F.format_string("%.2f", "w").alias("run_id"), "date",
        (F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")).alias("net"))
    raw = mix.groupBy("run_id").agg(safe_div(F.avg("net") * TRADING_DAYS ** 0.5,
                                             F.stddev_pop("net")).alias("sharpe_raw"))
    return sharpe_stats(mix, every).join(raw, "run_id").withColumnRenamed("run_id", "weight")


def pnl_correlation(pnl: DataFrame, first: str, second: str) -> DataFrame:
    """Correlation over common dates and dates dropped on either side."""
    legs = (pnl.where(F.col("run_id").isin(first, second)).groupBy("date")
            .agg(F.max(F.when(F.col("run_id") == first, F.col("net"))).alias("a"),
                 F.max(F.when(F.col("run_id") == second, F.col("net"))).alias("b")))
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return legs.agg(safe_corr("a", "b").alias("pnl_corr"),
                    F.count_if(has_a & has_b).alias("common"),
                    F.count_if(has_a & ~has_b).alias("dropped_first"),
                    F.count_if(has_b & ~has_a).alias("dropped_second"))


def common_legs(pnl: DataFrame, runs: Sequence[str]) -> DataFrame:
    """(date, legs): the profits of all ``runs`` as an array, on dates that all have."""
    legs = pnl.where(F.col("run_id").isin(*runs) & F.col("net").isNotNull()).groupBy("date").agg(
        F.count_distinct("run_id").alias("_k"), *[F.max(F.when(F.col("run_id") == r, F.col("net"))).alias(f"_{i}")
                                                  for i, r in enumerate(runs)])
    return legs.where(F.col("_k") == len(runs)).select("date", F.array(*[f"_{i}" for i in range(len(runs))]).alias("legs"))


def simplex(n: int, most: int | None = None) -> list[tuple[float, ...]]:
    """Equal weights over every subset of n series of up to ``most``, singles first."""
    from itertools import combinations
    return [tuple(1.0 / k if i in chosen else 0.0 for i in range(n))
            for k in range(1, (most or n) + 1) for chosen in combinations(range(n), k)]


def blend_series(pnl: DataFrame, runs: Sequence[str], weights: Sequence[Sequence[float]] | None = None,
                 every: int = 63) -> DataFrame:
    """Blends of any number of profit series over their common dates, one row per
    weight vector (default: equal weights over every subset): Sharpe on all rows and
    on every n-th row, return and drawdown. ``weight`` writes the vector in percent."""
    grid = weights or simplex(len(runs))
    named = F.explode(F.array(*[F.struct(F.lit("/".join(f"{100 * x:.0f}" for x in w)).alias("run_id"),
                                         F.array(*[F.lit(float(x)) for x in w]).alias("w")) for w in grid])).alias("g")
    mix = common_legs(pnl, runs).select("date", "legs", named).select("g.run_id", "date", F.aggregate(
        F.zip_with("legs", "g.w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("net"))
    raw = mix.groupBy("run_id").agg(safe_div(F.avg("net") * TRADING_DAYS ** 0.5, F.stddev_pop("net")).alias("sharpe_raw"))
    return sharpe_stats(mix, every).join(raw, "run_id").withColumnRenamed("run_id", "weight")


def pnl_correlations(pnl: DataFrame, runs: Sequence[str]) -> DataFrame:
    """(first, second, pnl_corr, common, dropped_first, dropped_second) of every pair
    of ``runs``, each over the dates the two share: one pass over dates gathers the
    co-moments of all pairs."""
    legs = pnl.where(F.col("run_id").isin(*runs)).groupBy("date").agg(
        *[F.max(F.when(F.col("run_id") == r, F.col("net"))).alias(f"_{i}") for i, r in enumerate(runs)])
    pairs = [(i, j) for i in range(len(runs)) for j in range(i + 1, len(runs))]
    cells = [F.struct(F.lit(runs[i]).alias("first"), F.lit(runs[j]).alias("second"), safe_corr(f"_{i}", f"_{j}").alias("pnl_corr"),
                      F.count_if(F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull()).alias("common"),
                      F.count_if(F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNull()).alias("dropped_first"),
                      F.count_if(F.col(f"_{j}").isNotNull() & F.col(f"_{i}").isNull()).alias("dropped_second")) for i, j in pairs]
    return legs.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def sweep_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    b = before.select("model", "horizon", F.col("sharpe").alias("sharpe_before"))
    return now.select("model", "horizon", "sharpe").join(b, ["model", "horizon"], "full") \
        .withColumn("delta", F.col("sharpe") - F.col("sharpe_before"))


def oos_series(preds: DataFrame) -> DataFrame:
    """Out-of-sample rows of all folds, numbered in time order per run."""
    w = Window.partitionBy("run_id").orderBy("fold_id", "date")
    return preds.withColumn("pos_in_run", F.row_number().over(w) - 1)


def ndcg(preds: DataFrame, k: int) -> DataFrame:
    """NDCG@k per run and date with gain 2^relevance - 1, relevance being the
    rank of the realized value within the date (0 = worst). Both cuts at k are
    group limits, so only k rows per date reach the sums."""
    keys = ["run_id", "date"]
    df = row_rank(pairs(preds), keys, ["realized", "asset"], "rel")
    df = df.withColumn("rel", F.col("rel") - 1)

    def dcg(name: str, *order: Column) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        top = df.withColumn("_at", at).where(F.col("_at") <= k)
        return top.groupBy(*keys).agg(F.sum(
            (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("_at") + 1.0)).alias(name))
    got = dcg("dcg", F.desc("pred"), F.asc("asset"))
    best = dcg("ideal", F.desc("rel"))
    return got.join(best, keys).select(*keys, safe_div("dcg", "ideal").alias(f"ndcg_{k}"))
