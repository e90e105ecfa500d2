"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``FIT_ROWS``); every vector is put in the
leaf it descends to. A query walks the tree best bin first: a priority queue holds
the branches not taken, nearest centre first, and leaves are visited in that order
until the calibrated number is reached and enough candidates are in sight. The
number is set on ``CALIBRATION`` sampled queries whose true neighbours among all
rows are known: visits widen until ``RECALL`` of them lie in visited leaves.

Vectors and visiting queries meet by bundles of neighbouring leaves, where a query
sees the leaves it visits. The vectors and the queries of a bundle are dealt into
blocks of bounded size, every pair of blocks being one group, so a vector that a
third of all rows share fills no task. Each group gives at most k rows per query.
Distances are computed in double precision from the original components.

Edge cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another length than most; rows without an id take no part;
a candidate id that repeats counts once, at its nearest vector, and a query id that
repeats is searched once; ties go to the smaller id; with fewer than k candidates
all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable

FIT_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLE = 48
CALIBRATION = 200
RECALL = 0.98
BLOCK_ROWS = 4096
ROUNDS = 8


@dataclass
class Node:
    """Centres of the children, or the number of a leaf."""
    leaf: int = -1
    centres: np.ndarray | None = None
    children: list["Node"] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = squared(x, centres).argmin(1)
        centres = np.array([x[own == i].mean(0) for i in range(len(centres)) if (own == i).any()])
    return centres, squared(x, centres).argmin(1)


def grow(x: np.ndarray, rng: np.random.Generator, leaves: list[int]) -> Node:
    if len(x) > LEAF_SAMPLE:
        centres, own = kmeans(x, BRANCHES, rng)
        if len(np.unique(own)) > 1:
            used = np.unique(own)
            return Node(-1, centres[used], [grow(x[own == i], rng, leaves) for i in used])
    leaves.append(len(leaves))
    return Node(leaves[-1])


def assign(tree: Node, x: np.ndarray) -> np.ndarray:
    """Leaf of each vector: the nearest centre at every level."""
    out = np.zeros(len(x), np.int32)
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if node.leaf >= 0:
            out[at] = node.leaf
        elif len(at):
            own = squared(x[at], node.centres).argmin(1)
            stack += [(child, at[own == i]) for i, child in enumerate(node.children)]
    return out


def best_bins(tree: Node, q: np.ndarray) -> Iterator[int]:
    """Leaves in the order best-bin-first search visits them."""
    heap, tie = [(0.0, 0, tree)], 0
    while heap:
        node = heapq.heappop(heap)[2]
        while node.leaf < 0:
            d = ((node.centres - q) ** 2).sum(1)
            first = int(d.argmin())
            for i, child in enumerate(node.children):
                if i != first:
                    tie += 1
                    heapq.heappush(heap, (float(d[i]), tie, child))
            node = node.children[first]
        yield node.leaf


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int,
            seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, distances) of each query's k nearest distinct ids, ties
    to the smaller id; ``seen`` (query, vector) tells which vectors a query meets.
    Products choose the candidates, with room for rounding; the distances themselves
    are differences squared."""
    many = k + 1 + len(ids) - len(np.unique(ids))
    for lo in range(0, len(q), 256):
        rough = squared(q[lo:lo + 256], x)
        for i, row in enumerate(rough, lo):
            meets = ids != own[i] if seen is None else (ids != own[i]) & seen[i]
            row = np.where(meets, row, np.inf)
            edge = np.partition(row, many - 1)[many - 1] if many <= len(row) else np.inf
            slack = 1e-9 * ((q[i] ** 2).sum() + 1) + 1e-9 * (edge if np.isfinite(edge) else 0)
            at = np.flatnonzero((row <= edge + slack) & meets)
            d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
            order = np.lexsort((ids[at], d))
            _, first = np.unique(ids[at][order], return_index=True)
            order = order[np.sort(first)[:k]]
            yield i, ids[at][order], d[order]


def bundles(counts: np.ndarray, scale: float) -> np.ndarray:
    """Bundle of each leaf: neighbouring leaves together, up to some ``BLOCK_ROWS``
    vectors as the sample's ``counts`` tell."""
    before = np.cumsum(counts) - counts
    return (before * scale // BLOCK_ROWS).astype(np.int32)


def table_of(rows: list[tuple[int, np.ndarray, np.ndarray]], own: np.ndarray) -> pa.Table:
    if not rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
    return pa.table({"query_id": np.concatenate([np.full(len(v), own[i], np.int64) for i, v, _ in rows]),
                     "vec_id": np.concatenate([v for _, v, _ in rows]).astype(np.int64),
                     "score": np.concatenate([d for _, _, d in rows])})


def eligible(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col("v")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    common = ok.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    return ok.where(F.size("v") == dim), dim


def brute_force(queries: tuple[np.ndarray, np.ndarray], rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf) of the true neighbours of a few given queries:
    each task keeps k rows per query while it reads its part of ``rows``
    (vec_id, v, leaf)."""
    own, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {i: [] for i in range(len(q))}
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            leaf = dict(zip(ids.tolist(), b.column("leaf").to_pylist()))
            for i, v, d in nearest(q, own, matrix(b.column("v"), dim), ids, k) if len(ids) else ():
                best[i] = sorted({*best[i], *((s, n, leaf[n]) for s, n in zip(d.tolist(), v.tolist()))})[:k]
        out = [(int(own[i]), n, s, f) for i, rows_ in best.items() for s, n, f in rows_]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int32()))],
                ["query_id", "vec_id", "score", "leaf"])
    return top(rows.mapInArrow(run, "query_id long, vec_id long, score double, leaf int"), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows per query with rank; group limits cut rows ahead of the
    shuffle."""
    extra = [c for c in found.columns if c not in ("query_id", "vec_id", "score")]
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"),
                                                   *[F.first(c).alias(c) for c in extra])
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows of ``vectors``
    (vec_id, embedding) whose id is divisible by ``every``, among all other rows. An id
    asked with several vectors is asked with the smallest, entry by entry."""
    rows, dim = eligible(vectors)
    n = rows.count()
    share = int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    sample = sorted((r.vec_id, r.v) for r in rows.where(drawn <= share).limit(2 * FIT_ROWS).collect())
    x = np.array([v for _, v in sample], np.float64).reshape(len(sample), dim)
    leaves: list[int] = []
    tree = grow(x, np.random.default_rng(5), leaves)
    bundle = bundles(np.bincount(assign(tree, x), minlength=len(leaves)), n / max(1, len(x)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = assign(tree, matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array(leaf), pa.array(bundle[leaf])],
                    ["vec_id", "v", "leaf", "bundle"])
    placed = durable(rows.mapInArrow(place, "vec_id long, v array<double>, leaf int, bundle int"))
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}   # one row per leaf
    visits = calibrated(tree, sample, x, placed, dim, k)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, where, met = [], [], []
            for i, q in enumerate(matrix(b.column("v"), dim)):
                seen = done = 0
                by_bundle: dict[int, list[int]] = {}
                for name in best_bins(tree, q):
                    if done >= visits and seen > 2 * k:
                        break
                    done, seen = done + 1, seen + sizes.get(name, 0)
                    by_bundle.setdefault(int(bundle[name]), []).append(name)
                at += [i] * len(by_bundle)
                where += by_bundle
                met += by_bundle.values()
            if at:
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at)),
                     pa.array(where, pa.int32()), pa.array(met, pa.list_(pa.int32()))],
                    ["query_id", "q", "bundle", "leaves"])
    asked = durable(placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(
        walk, "query_id long, q array<double>, bundle int, leaves array<int>"))
    have = {r.bundle: r["count"] for r in placed.groupBy("bundle").count().collect()}
    asks = {r.bundle: r["count"] for r in asked.groupBy("bundle").count().collect()}

    def blocks(counts: dict[int, int]) -> F.Column:
        """Number of blocks of a bundle: a lookup of those that need several."""
        several = {b: math.ceil(c / BLOCK_ROWS / 2) for b, c in counts.items() if c > 2 * BLOCK_ROWS}
        if not several:
            return F.lit(1)
        lookup = F.create_map(*[F.lit(y) for item in several.items() for y in item])
        return F.coalesce(F.element_at(lookup, F.col("bundle")), F.lit(1))

    def dealt(df: DataFrame, name: str, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64(name), blocks(own)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), (blocks(other) - 1).cast("int"))))

    keys = ["bundle", "vb", "qb"]
    right = dealt(placed, "vec_id", have, asks, "vb", "qb")
    left = dealt(asked, "query_id", asks, have, "qb", "vb")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        own = a.column("query_id").to_numpy()
        if not len(own) or not b.num_rows:
            return table_of([], own)
        leaf = b.column("leaf").to_numpy()
        q, v, ids = matrix(a.column("q"), dim), matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
        met = a.column("leaves").to_pylist()
        out = []
        for lo in range(0, len(own), 256):
            seen = np.array([np.isin(leaf, m) for m in met[lo:lo + 256]])
            out += [(i + lo, n, d) for i, n, d in nearest(q[lo:lo + 256], own[lo:lo + 256], v, ids, k, seen)]
        return table_of(out, own)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    return top(found, k).select("query_id", "rank", "vec_id", "score")


def calibrated(tree: Node, sample: list, x: np.ndarray, placed: DataFrame, dim: int, k: int) -> int:
    """The fewest leaf visits that find ``RECALL`` of the sampled queries' true
    neighbours."""
    distinct = np.unique(x, axis=0, return_index=True)[1]         # copies are easy: they count once
    some = np.random.default_rng(9).permutation(distinct)[:CALIBRATION]
    if not len(some):
        return 1
    own, q = np.array([sample[i][0] for i in some], np.int64), x[some]
    ranks = []
    order = {int(o): {leaf: r for r, leaf in enumerate(best_bins(tree, v))} for o, v in zip(own, q)}
    for r in brute_force((own, q), placed, dim, k).collect():                # k rows per sampled query
        ranks.append(order[r.query_id][r.leaf])
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)) - 1)]) + 1
