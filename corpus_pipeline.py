"""From raw documents to packed training bins, in five stages.

Quality rules drop documents, near-dedup keeps one of each group, secrets are
masked, sources are mixed to target weights, and pieces are packed into bins. All
stages but the last return the columns of ``documents``. Each stage reads what the
one before wrote. Nulls, empty texts, repeated rows, empty tables and extra
columns are handled as the stages' operators state; see their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, secrets, simhash
from tidemark.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their group."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component: first by
    fingerprints, then by a similarity of 0.8 on five-word shingles. Of rows repeated
    with one id and text one stays; rows without an id all stay."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its words, its bin and its place there."""
    return packing.pack(packing.as_items(docs))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scan", secret_scan),
          ("source mix", mix_sources), ("best-fit packing", pack_bins)]

#: Neither the outlier estimate, the random field nor best-fit packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"pipeline-stage-{k + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
