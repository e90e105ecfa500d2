"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), where the component
    is the smallest node reachable. Repeated links are allowed; a node with no
    link but to itself is left out.

    Each round points every node at the smallest neighbour it knows, first for
    larger neighbours, then for smaller ones; rounds grow as the logarithm of the
    longest chain. A star's centre meets its minimum by partial aggregation, so a
    node with a third of all links sends one row per task. Rounds end when links
    no longer change, told by a count and an order-free checksum."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                 F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = attach(both.where("b > a"), low, ["a"], "inner").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = attach(large, low, ["a"], "inner")
        edges = durable(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .union(low.select("a", F.col("m").alias("b")))
                        .where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select("component", "component").distinct())
