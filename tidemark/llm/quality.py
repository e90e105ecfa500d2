"""Quality rules: robust multivariate outliers among text statistics.

Each document gives four transformed statistics: its mean word length, symbol
density, share of repeated lines and share of repeated words. Per language and
source a minimum-covariance-determinant estimate describes the bulk, and a
document whose Mahalanobis distance passes a far chi-square quantile is rejected.

The estimate is found by concentration steps over all rows of a group at once. A
step bins the distances on a fine log scale and sums counts and moments per
(group, bin); the smallest bins that hold ``SUPPORT`` of the group make the next
subset. That is one partial aggregation, whose output is bounded by the bins, so a
source holding a third of all rows moves no more than any other. Two starts,
robust per coordinate and classical, run side by side, and the smaller
determinant wins. Statistics are rounded to 1/64 of their least deviation, so sums
are exact and reruns agree.

Everything here is built of DataFrame functions.

Edge cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; a group of fewer than ``MIN_ROWS``
documents that pass the base rule shares an estimate with the other small groups
of its language, then of all languages, and a remainder smaller than that is not
judged; identical rows count each; repeated ids give a row each; an empty table
gives no rows. Columns other than doc_id, lang, source and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, attach, attach_counted, durable, fenced, words

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: Share of a group whose covariance determinant is minimised, and steps taken.
SUPPORT = 0.75
STEPS = 5
MIN_ROWS = 50
#: A clean document passes with this probability, were statistics normal.
PASS = 1 - 1e-12
DIMS = 4


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return lo


#: Makes the covariance of the central part consistent for normal data.
CONSISTENCY = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, DIMS), DIMS + 2)
CUTOFF = chi2_quantile(PASS, DIMS)


def repeat_words(df: DataFrame) -> DataFrame:
    """Replace ``grams`` (array of window hashes by position) by n_repeat_words,
    the words covered by windows whose hash occurs twice or more.

    Texts without a repeated hash, nearly all, stop at the set of distinct hashes.
    Each step is a column of its own, so that it is computed once."""
    n = F.size("grams")
    pairs = F.when(F.size(F.array_distinct("grams")) < n, F.sort_array(F.transform(
        "grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("pairs", pairs).drop("grams")
    n = F.size("pairs")
    hits = F.zip_with(F.slice("pairs", F.lit(1), n - 1), F.slice("pairs", F.lit(2), n - 1),
                      lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    df = df.withColumn("at", F.when(F.col("pairs").isNotNull(), F.sort_array(F.array_distinct(
        F.flatten(F.filter(hits, lambda x: x.isNotNull())))))).drop("pairs")
    n = F.size("at")
    gaps = F.zip_with(F.slice("at", F.lit(1), n - 1), F.slice("at", F.lit(2), n - 1),
                      lambda a, b: F.least(b - a, F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)
    return df.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), total)
                         .otherwise(F.lit(0).cast("long"))).drop("at")


KEYS = ["doc_id", "lang", "source"]


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed) per row, and the columns named in ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*KEYS, *keep, text.alias("text")).select(
        *KEYS, *keep, words("text").alias("w"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias("lines"))
    n = F.size("w")
    grams = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])))
    counted = split.select(
        *KEYS, *keep, n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"))
    out = fenced(repeat_words(counted), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                 "n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10)
                          | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def coordinates(length_centre: Column) -> list[Column]:
    """The four statistics in units of their least deviation.

    Shares of small counts are stabilised by square roots over padded totals; the
    mean word length is measured from the group's centre and damped for short
    texts, whose mean varies by chance."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")          # texts without words fail before
    mean = F.col("word_chars") / n
    raw = [(mean - length_centre) / F.sqrt(F.lit(0.02) + 1 / n) / 2.0,
           F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 50.0)) / 0.03,
           F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)) / 0.12,
           F.sqrt(F.col("n_repeat_words") / (n + 50.0)) / 0.12]
    return [F.round(F.greatest(F.lit(-1e3), F.least(F.lit(1e3), c)) * 64) / 64 for c in raw]


GROUP = ["g_lang", "g_source", "g_level"]


def groups(rows: DataFrame) -> DataFrame:
    """Per language and source, the group whose estimate judges it: its own, or a
    pool of small groups. Level 3 is not judged."""
    n1 = durable(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    small = n1.where(F.col("n") < MIN_ROWS)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rest = by_lang.where(F.col("n_lang") < MIN_ROWS).agg(F.sum("n_lang")).first()[0] or 0
    levels = attach(n1, by_lang, ["lang"]).withColumn(
        "g_level", F.when(F.col("n") >= MIN_ROWS, 0).when(F.col("n_lang") >= MIN_ROWS, 1)
        .otherwise(2 if rest >= MIN_ROWS else 3))
    return durable(levels.select(
        "lang", "source", "g_level",
        F.when(F.col("g_level") <= 1, F.col("lang")).alias("g_lang"),
        F.when(F.col("g_level") == 0, F.col("source")).alias("g_source")))


def binned_quantile(rows: DataFrame, value: Column, p: float, step: float) -> DataFrame:
    """Per group, the lower edge q of the first bin at which the share reaches p."""
    bins = rows.groupBy(*GROUP, F.floor(value / step).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*GROUP).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*GROUP)
    return (bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(all_))
            .where(F.col("upto") >= p * F.col("all"))
            .groupBy(*GROUP).agg((F.min("bin") * step).alias("q")))


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def moments() -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
            + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS])


def cholesky(estimates: DataFrame) -> DataFrame:
    """Add means m, the Cholesky factor l of the covariance, its inverse diagonal
    r and the log determinant. The least deviation, one unit, is added to every
    variance, so a constant statistic gives no singular matrix."""
    n = F.col("n").cast("double")
    out = estimates.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(DIMS)})
    out = out.withColumns({
        f"c{i}{j}": CONSISTENCY * (F.col(f"p{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}"))
        + (1.0 if i == j else 0.0) for i, j in PAIRS})
    for i in range(DIMS):
        for j in range(i + 1):
            inner = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"),    # noqa: B023
                           range(j), F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(1e-9))) if i == j
                                 else inner / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, [F.log(F.col(f"l{i}{i}")) for i in range(DIMS)])
    return out.withColumn("logdet", det).select(
        *[c for c in estimates.columns if c in GROUP + ["start"]], "n", "logdet",
        *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i in range(DIMS):
        v = reduce(lambda a, k: a - F.col(f"l{i}{k}") * z[k], range(i),       # noqa: B023
                   F.col(f"x{i}") - F.col(f"m{i}"))
        z.append(v / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for every group and start."""
    keys = [*GROUP, "start"]
    near = attach_counted(rows, estimates, GROUP, "inner").withColumn(
        "bin", F.floor(16 * F.log2(distance() + 1e-3)))
    bins = near.groupBy(*keys, "bin").agg(*moments())
    w = Window.partitionBy(*keys)
    chosen = (bins.withColumn("before", F.coalesce(F.sum("n").over(
        w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all", F.sum("n").over(w))
        .where(F.col("before") < SUPPORT * F.col("all")))
    sums = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in PAIRS]]
    return cholesky(chosen.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]))


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of every group of ``rows`` (GROUP, x0 .. x3)."""
    classical = cholesky(rows.groupBy(*GROUP).agg(*moments())).withColumn("start", F.lit(0))
    robust = None
    for i in range(DIMS):
        q = [binned_quantile(rows, F.col(f"x{i}"), p, 1 / 16).withColumnRenamed("q", f"q{k}")
             for k, p in enumerate((0.25, 0.5, 0.75))]
        one = attach(attach(q[0], q[1], GROUP, "inner"), q[2], GROUP, "inner").select(
            *GROUP, F.col("q1").alias(f"m{i}"),
            ((F.col("q2") - F.col("q0")) / 1.349 + 1.0).alias(f"l{i}{i}"))
        robust = one if robust is None else attach(robust, one, GROUP, "inner")
    robust = robust.withColumns({f"l{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j}).withColumns(
        {"start": F.lit(1), "n": F.lit(0).cast("long"), "logdet": F.lit(0.0)})
    now = durable(classical.unionByName(robust))
    for _ in range(STEPS):
        now = durable(concentrate(rows, now))
    best = Window.partitionBy(*GROUP).orderBy("logdet", "start")
    return durable(now.withColumn("rank", F.row_number().over(best)).where("rank = 1")
                   .drop("rank", "start"))


Fitted = tuple[DataFrame, DataFrame, DataFrame]


def fit(stats: DataFrame) -> Fitted:
    """Groups, the centre of mean word length per group, and the estimates: three
    tables of one row per group."""
    base = stats.where(~F.col("base_failed"))
    names = groups(base)
    rows = attach_counted(base, names, ["lang", "source"], "inner").where(F.col("g_level") < 3)
    centre = durable(binned_quantile(rows, F.col("word_chars") / F.col("n_words"), 0.5, 1 / 32)
                     .withColumnRenamed("q", "centre"))
    xs = coordinates(F.col("centre"))
    placed = durable(attach_counted(rows, centre, GROUP, "inner").select(
        *GROUP, *[xs[i].alias(f"x{i}") for i in range(DIMS)]))
    return names, centre, estimates(placed).drop("n", "logdet")


def verdicts(stats: DataFrame, fitted: Fitted) -> DataFrame:
    """Add distance (null where not judged) and kept. The tables of one row per
    group come to the rows; no row is shuffled while groups are few."""
    names, centre, fits = fitted
    rows = attach_counted(stats, names, ["lang", "source"])
    rows = attach_counted(attach_counted(rows, centre, GROUP), fits, GROUP)
    xs = coordinates(F.col("centre"))
    rows = rows.withColumns({f"x{i}": xs[i] for i in range(DIMS)})
    d = F.when(~F.col("base_failed"), distance())
    return rows.select(*stats.columns, d.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def judge(docs: DataFrame) -> DataFrame:
    """``statistics`` of every row plus distance and kept."""
    stats = durable(statistics(docs))
    return verdicts(stats, fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns kept. Statistics are computed
    anew beside the texts, which saves a shuffle of the texts."""
    fitted = fit(durable(statistics(docs)))
    rows = docs.select("doc_id", "lang", "source", "text", F.struct(*docs.columns).alias("_row"))
    return verdicts(statistics(rows, ("_row",)), fitted).where("kept").select("_row.*")
