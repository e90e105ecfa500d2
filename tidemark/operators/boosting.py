"""Boosted trees for many models at once: every (asset, fold, objective) in one loop.

A library fit takes one training set at a time; a walk-forward over assets has
thousands. Here all models grow their trees together, as grouped aggregates: a level
of every tree is one histogram of gradients by (model, leaf, feature, bin), a window
over its bins and a join of the chosen splits back to the rows. Histograms combine
map-side, so what is shuffled depends on models, leaves and bins, not on rows.

Rows carry ``part``: ``fit`` rows grow trees, ``val`` rows choose the number of
rounds, ``test`` rows are only scored. Bin edges and starting values come from ``fit``
rows alone. A row without features or label must be dropped by the caller, unless it
is a test row, whose null features fall into the lowest bin.

Each round is written to the shared folder: a lost executor costs that round at most,
plans do not grow, and sizes of splits and leaves are known to the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import stored
from tidemark.functions.expr import safe_div
from tidemark.functions.ranks import row_rank

#: Bins of a feature; digits of a gain that count.
BINS, DIGITS = 16, 8
#: Accuracy of the quantiles of edges and leaves: exact up to this many rows a group.
ACCURACY = 100_000
#: Places of a date that the listwise objective looks at.
TOP = 10


def binned(rows: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Rows with ``b``, the bin of each feature by the model's own fit rows."""
    cuts = [k / bins for k in range(1, bins)]
    edges = rows.where("part = 'fit'").groupBy(*keys).agg(
        *[F.percentile_approx(c, cuts, ACCURACY).alias(f"_e_{c}") for c in features])

    def bin_of(c: str) -> Column:
        return F.size(F.filter(f"_e_{c}", lambda e: F.coalesce(F.col(c) > e, F.lit(False))))
    return rows.join(edges, list(keys)).withColumn("b", F.array(*[bin_of(c) for c in features])).drop(*[f"_e_{c}" for c in features])


def grown(state: DataFrame, keys: Sequence[str], depth: int, reg: float, min_leaf: int) -> DataFrame:
    """``state`` with ``leaf``: one tree of each model on the gradients ``g`` and
    weights ``h`` of its fit rows. A leaf that no split improves stays whole."""
    keys = list(keys)
    state = state.withColumn("leaf", F.lit(0))
    for _ in range(depth):
        fit = state.where("part = 'fit'").select(*keys, "leaf", "g", "h", F.posexplode("b").alias("f", "v"))
        hist = fit.groupBy(*keys, "leaf", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"),
                                                        F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy(*keys, "leaf", "f")
        upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sides = hist.select(*keys, "leaf", "f", "v", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"],
                            *[F.sum(c).over(whole).alias(f"{c}a") for c in "ghn"])

        def score(g: Column, h: Column) -> Column:
            return safe_div(g * g, h + reg)
        gain = (score(F.col("gl"), F.col("hl")) + score(F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl"))
                - score(F.col("ga"), F.col("ha")))
        best = (sides.where((F.col("nl") >= min_leaf) & (F.col("na") - F.col("nl") >= min_leaf))
                .withColumn("gain", F.format_string(f"%.{DIGITS}e", gain).cast("double")).where("gain > 1e-12")
                .groupBy(*keys, "leaf").agg(F.max_by(F.struct("f", "v"), F.struct("gain", -F.col("f"), -F.col("v"))).alias("s")))
        right = F.coalesce(F.element_at("b", F.col("s.f") + 1) > F.col("s.v"), F.lit(False)).cast("int")
        state = (state.join(stored(best, "splits"), [*keys, "leaf"], "left")
                 .withColumn("leaf", F.col("leaf") * 2 + right).drop("s"))
    return state


def _loop(state: DataFrame, keys: Sequence[str], gradients, leaf_value: Column, rounds: int, depth: int,
          step: float, reg: float, min_leaf: int) -> DataFrame:
    """Boosting rounds; ``path`` collects the score of val and test rows after each."""
    keys = list(keys)
    columns = state.columns
    state = stored(state, "boost")
    for _ in range(rounds):
        rows = grown(stored(gradients(state), "boost"), keys, depth, reg, min_leaf)
        values = rows.where("part = 'fit'").groupBy(*keys, "leaf").agg(leaf_value.alias("_v"))
        score = F.col("score") + step * F.coalesce("_v", F.lit(0.0))
        state = rows.join(stored(values, "leaves"), [*keys, "leaf"], "left").withColumn("score", score).withColumn(
            "path", F.when(F.col("part") != "fit", F.concat("path", F.array("score")))).select(*columns)
    return stored(state, "boost")


def _chosen(state: DataFrame, keys: Sequence[str], losses: DataFrame) -> DataFrame:
    """Test rows with ``pred`` after the round of least loss (ties: the earlier);
    models without val rows use all rounds. ``losses`` is (*keys, round, loss)."""
    best = losses.groupBy(*keys).agg(F.min_by("round", F.struct(F.round("loss", 10), F.col("round"))).alias("_r"))
    pick = F.element_at("path", F.coalesce(F.col("_r") + 1, F.size("path")))
    return state.where("part = 'test'").join(best, list(keys), "left").withColumn("pred", pick).drop("_r")


def boost(rows: DataFrame, keys: Sequence[str], features: Sequence[str], objectives: dict[str, float | None],
          rounds: int = 20, depth: int = 3, step: float = 0.1, reg: float = 0.1, min_leaf: int = 20) -> DataFrame:
    """(*keys, model, date, asset, pred, realized) of test rows. ``objectives`` names
    models with the quantile each fits by pinball loss, or None for squared error.
    Quantile trees are grown on the sign of the loss; their leaves move by the
    quantile of the residuals in them."""
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(q).cast("double").alias("q")) for m, q in objectives.items()])
    own = [*keys, "model"]
    state = binned(rows, keys, features).select(*keys, "date", "asset", "part", F.col("target").alias("y"), "b",
                                                F.explode(names).alias("m")).select("*", "m.model", "m.q").drop("m")
    levels = sorted({q for q in objectives.values() if q is not None})

    def quantile(value: Column) -> Column:
        """The model's own quantile of a group, found among those asked for."""
        if not levels:
            return F.lit(None).cast("double")
        found = F.percentile_approx(value, levels, ACCURACY)
        return F.coalesce(*[F.when(F.first("q") == q, F.element_at(found, k + 1)) for k, q in enumerate(levels)])
    squared = F.first("q").isNull()
    start = state.where("part = 'fit'").groupBy(*own).agg(
        F.when(squared, F.avg("y")).otherwise(quantile(F.col("y"))).alias("score"))
    state = state.join(start, own).withColumn("path", F.when(F.col("part") != "fit", F.array().cast("array<double>")))

    def gradients(s: DataFrame) -> DataFrame:
        pinball = F.col("q") - (F.col("y") < F.col("score")).cast("double")
        return s.withColumn("g", F.when(F.col("q").isNull(), F.col("y") - F.col("score")).otherwise(pinball)).withColumn("h", F.lit(1.0))
    leaf = F.when(squared, safe_div(F.sum("g"), F.sum("h") + reg)).otherwise(quantile(F.col("y") - F.col("score")))
    state = _loop(state, own, gradients, leaf, rounds, depth, step, reg, min_leaf)
    e = F.col("y") - F.col("s")
    loss = F.when(F.col("q").isNull(), e * e).otherwise(F.greatest(F.col("q") * e, (F.col("q") - 1) * e))
    losses = (state.where("part = 'val'").select(*own, "q", "y", F.posexplode("path").alias("round", "s"))
              .groupBy(*own, "round").agg(F.avg(loss).alias("loss")))
    return _chosen(state, own, losses).select(*own, "date", "asset", "pred", F.col("y").alias("realized"))


# ── listwise ranking ────────────────────────────────────────────────────────
def _discount(place: Column) -> Column:
    """Weight of a place from 1 on; nothing beyond TOP."""
    return F.when(place <= TOP, 1.0 / F.log2(place + 1)).otherwise(0.0)


def _ideal(n: Column, places: int) -> Column:
    """Best gain within the first places of a date of n rows, scaled by 2^(n - 1)."""
    return sum((F.when(n > p, (F.lit(2.0 ** -p) - F.pow(F.lit(2.0), 1.0 - n)) / F.log2(F.lit(p + 2.0))).otherwise(0.0)
                for p in range(places)), F.lit(0.0))


def _gain(rel: Column, n: Column) -> Column:
    return F.pow(F.lit(2.0), rel - n + 1) - F.pow(F.lit(2.0), 1.0 - n)


def lambdas(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gradient ``g`` and weight ``h`` of each fit row (score, rel, n): over the others
    of its date, the pull of the pairwise logistic loss times the change in NDCG@TOP
    that swapping the two would bring. A swap changes nothing unless one of the two is
    among the first TOP, so each row meets these few only, and they receive the
    mirrored sums of the rest by partial aggregation."""
    on = [*keys, "part", "date"]
    order = Window.partitionBy(*on).orderBy(F.desc("score"), "asset")
    top = (rows.where("part = 'fit'").select(*on, "asset", "score", "rel", "gain").withColumn("place", F.row_number().over(order))
           .where(F.col("place") <= TOP))                                            # a group limit ahead of the shuffle
    tops = top.withColumn("disc", _discount(F.col("place"))).groupBy(*on).agg(
        F.collect_list(F.struct("asset", "score", "rel", "gain", "disc")).alias("tops"))
    mine = F.filter("tops", lambda t: t["asset"] == F.col("asset"))
    met = rows.join(tops, on, "left").withColumn("disc", F.try_element_at(mine, F.lit(1))["disc"])

    def pair(t: Column) -> Column:
        up = F.when(F.col("rel") > t["rel"], 1.0).otherwise(-1.0)
        rho = 1.0 / (1.0 + F.exp(up * (F.col("score") - t["score"])))
        delta = F.abs(F.col("gain") - t["gain"]) * F.abs(F.coalesce("disc", F.lit(0.0)) - t["disc"])
        return F.struct(t["asset"].alias("asset"), (up * rho * delta).alias("g"), (rho * (1.0 - rho) * delta).alias("h"))
    pairs = met.withColumn("pairs", F.transform(F.filter("tops", lambda t: t["asset"] != F.col("asset")), pair))
    total = lambda c: F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p[c])
    own = pairs.withColumn("g", total("g")).withColumn("h", total("h"))
    mirrored = (pairs.where("disc IS NULL AND pairs IS NOT NULL").select(*on, F.inline("pairs"))
                .groupBy(*on, "asset").agg((-F.sum("g")).alias("_g"), F.sum("h").alias("_h")))
    return (own.drop("tops", "pairs", "disc").join(mirrored, [*on, "asset"], "left")
            .withColumn("g", safe_div(F.col("g") + F.coalesce("_g", F.lit(0.0)), F.col("ideal")))
            .withColumn("h", safe_div(F.col("h") + F.coalesce("_h", F.lit(0.0)), F.col("ideal"))).drop("_g", "_h"))


def listwise(rows: DataFrame, keys: Sequence[str], features: Sequence[str], rounds: int = 20, depth: int = 3,
             step: float = 0.1, reg: float = 0.1, min_leaf: int = 20, at: int = 3) -> DataFrame:
    """(*keys, date, asset, pred, realized) of test rows, from trees grown on the
    gradients of NDCG by date; the round is chosen by NDCG@``at`` of val dates."""
    keys = list(keys)
    on = [*keys, "date"]
    ranked = row_rank(rows.where("part <> 'test'"), on, ["target", "asset"], "rel").withColumn("rel", F.col("rel") - 1)
    sizes = ranked.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(sizes, on)
    both = ranked.unionByName(rows.where("part = 'test'"), allowMissingColumns=True)
    state = binned(both, keys, features).select(
        *keys, "date", "asset", "part", F.col("target").alias("y"), "rel", "b", _gain(F.col("rel"), F.col("n")).alias("gain"),
        _ideal(F.col("n"), TOP).alias("ideal"), _ideal(F.col("n"), at).alias("ideal_at"), F.lit(0.0).alias("score"),
        F.when(F.col("part") != "fit", F.array().cast("array<double>")).alias("path"))
    leaf = safe_div(F.sum("g"), F.sum("h") + reg)
    state = _loop(state, keys, lambda s: lambdas(s, keys), leaf, rounds, depth, step, reg, min_leaf)
    seen = state.where("part = 'val'").select(*on, "asset", "gain", "ideal_at", F.posexplode("path").alias("round", "s"))
    place = F.row_number().over(Window.partitionBy(*on, "round").orderBy(F.desc("s"), "asset"))
    gained = F.col("gain") / F.log2(F.col("place") + 1)
    ndcg = (seen.withColumn("place", place).where(F.col("place") <= at)
            .groupBy(*on, "round").agg(safe_div(F.sum(gained), F.max("ideal_at")).alias("ndcg")))
    losses = ndcg.groupBy(*keys, "round").agg((-F.avg("ndcg")).alias("loss"))
    return _chosen(state, keys, losses).select(*keys, "date", "asset", "pred", F.col("y").alias("realized"))


def fold_parts(panel: DataFrame, dates: DataFrame, keys: Sequence[str] = (), min_val: int = 10) -> DataFrame:
    """Panel rows with (fold_id, part): the training range of each fold is split into
    fit, an inner gap (left out) and val by its last dates. ``dates`` comes from
    ``walkforward.date_folds``."""
    on = [*keys, "fold_id"]
    w = Window.partitionBy(*on).orderBy("idx")
    train = dates.where("part = 'train'").drop("part").withColumn("at", F.row_number().over(w) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    start = n - F.greatest(F.lit(min_val), F.floor(n * 0.15))
    part = (F.when((start - 5 < 20) | (F.col("at") < start - 5), "fit").when(F.col("at") >= start, "val"))
    split = train.withColumn("part", part).where("part IS NOT NULL").drop("at")
    every = split.unionByName(dates.where("part = 'test'"))
    return panel.join(every, [*keys, "date"])
