"""Helpers that touch the cluster: durable lineage cuts and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names. Only a local session may go without:
    there the driver's temporary folder is every task's."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in shared storage, so a lost executor
    neither recomputes them nor sees a different partitioning."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder now and read back. Unlike a checkpoint's,
    their size is then known from the files: a checkpoint keeps the estimate of its
    plan, which joins in a loop multiply without end."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that ``lookup`` broadcasts at most.
LOOKUP_ROWS = 500_000


def lookup(df: DataFrame, label: str, rows: int = LOOKUP_ROWS) -> DataFrame:
    """A dimension to join to facts: written and counted now, and broadcast if it has
    at most ``rows`` rows, so that facts stay where they are. Beyond that Spark shuffles
    both sides as it does for any join."""
    small = stored(df, label)
    return F.broadcast(small) if small.count() <= rows else small
