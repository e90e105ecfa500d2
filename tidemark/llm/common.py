"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share, named by
    ``spark.checkpoint.dir``. Only a local session may go without: it gets a
    temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return (root or sc.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder now: a lost executor costs no
    recomputation, and later steps read the same rows in the same partitions."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def words(text: Column | str) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")),
                                F.lit(WORD), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns passed through a one-row generator. Filters and
    projections above it are not merged into what is below, so an expensive column
    used several times is computed once per row."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)


#: Tables of at most this many rows (one per source, group or leaf) are broadcast.
BROADCAST_ROWS = 20_000


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key, where null keys match null keys. No
    hint is given: Spark splits hot keys of large sides at run time."""
    renamed = small.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return df.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def attach_counted(df: DataFrame, small: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """``attach`` for a durable ``small``: its rows are counted, and it is broadcast
    only within the bound; beyond it the sides are shuffled."""
    return attach(df, F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys, how)
