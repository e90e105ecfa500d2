"""Mixing sources to target weights.

Tokens are summed per source, targets give each source a repetition rate, and
every document is emitted floor(rate) times plus once more by a hash-seeded
Bernoulli draw whose probability is the fraction.

The draws are uniform numbers cut from digests of (document id, block), so a
rerun or a recomputed task repeats them. A digest yields several draws per
document; each source uses the draw column whose total lies nearest its target,
which keeps the taken words close to it even for a source of few documents. The
chosen column is still one independent draw per document.

Edge cases: a null or empty text has size 0 and is copied by rate like any other;
a null source is a source of its own, ordered last; repeated rows of one id share
their draw and all count; a source of size 0 has target 0 and copies nothing; an
empty table gives no rows. Extra columns pass through ``mix``; those named like
its outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, attach_counted, durable, word_count

#: Draw columns: blocks of one md5 digest, each holding four 32-bit numbers.
BLOCKS = 4
DRAWS = 4 * BLOCKS


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for every source of ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights in turn. Together
    they get ``share`` times all tokens, none more than ``most`` times its own:
    with sources ordered by cap over weight, the capped ones are a prefix, found
    by running sums. The only ordered window runs over one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights) + 1
    cap = F.col("source_size") * F.lit(float(most))
    ranked = (by_source
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
              .withColumn("cap", cap))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * F.lit(float(share))
              - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_ = (ranked.withColumn("level", level).withColumn("place", F.row_number().over(ratio))
             .withColumn("free", F.col("cap") / F.col("weight") >= F.col("level")))
    final = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)
    return open_.withColumn("level", final["level"]).select(
        "source", "source_size",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def draws(doc_id: Column) -> Column:
    """Array of DRAWS uniform numbers in [0, 1), 32 bits each."""
    out = []
    for b in range(BLOCKS):
        digest = F.md5(F.concat(F.lit(f"mix:{b}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
                       .cast("binary"))
        for k in range(4):
            out.append(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
                       / F.lit(4294967296.0))
    return F.array(*out)


def plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
         most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, source, size) and, per source, (source_size, target, whole,
    fraction, column). Texts are read once; all later steps use the sizes."""
    sized = durable(docs.select("doc_id", "source", word_count("text").alias("size")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    goal = durable(targets(sized, weights, share, most)
                   .withColumn("whole", F.floor(rate).cast("long"))
                   .withColumn("fraction", rate - F.floor(rate)))
    # Tokens that each draw column would add, per source: partial sums in the tasks.
    extra = attach_counted(sized, goal, ["source"], "inner").withColumn(
        "draws", draws(F.col("doc_id"))).groupBy("source").agg(*[
            F.sum(F.when(F.col("draws")[k] < F.col("fraction"), F.col("size")).otherwise(0))
            .alias(f"x{k}") for k in range(DRAWS)])
    short = F.col("target") - F.col("whole") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"x{k}") - short).alias("off"),
                                          F.lit(k).alias("k")) for k in range(DRAWS)]))["k"]
    return sized, durable(attach(goal, extra, ["source"], "inner").select(
        "source", "source_size", "target", "whole", "fraction", best.alias("column")))


def copies() -> Column:
    """Times a row is taken, from its id and its source's plan."""
    draw = F.element_at(draws(F.col("doc_id")), F.col("column") + 1)
    return F.col("whole") + F.when(draw < F.col("fraction"), 1).otherwise(0)


def rates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of ``docs``
    (doc_id, source, text)."""
    sized, goal = plan(docs, **kw)
    return attach_counted(sized, goal, ["source"], "inner").select(
        "doc_id", "source", "size", "source_size", "target", copies().cast("long").alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, all
    columns kept. Texts meet the plan of their source where they are read."""
    goal = plan(docs, **kw)[1]
    goal = goal.select("source", *[F.col(c).alias(f"_mix_{c}") for c in ("whole", "fraction", "column")])
    rows = attach_counted(docs, goal, ["source"], "inner")
    draw = F.element_at(draws(F.col("doc_id")), F.col("_mix_column") + 1)
    times = F.col("_mix_whole") + F.when(draw < F.col("_mix_fraction"), 1).otherwise(0)
    copy = F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))))
    return rows.withColumn("_mix_copy", copy).select(*docs.columns)
