"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` tokens. A full piece is a bin
of its own; the rest are dealt to shards by a hash of their id and packed there,
largest first. Bins are kept in order of their residual and carry bitmaps of the
sources and duplicate clusters they hold. A piece takes the tightest bin that is
large enough and holds neither its source nor its cluster: the search starts at
the first residual that fits and goes on to the next until it finds one, and opens
a bin only if there is none.

Shards hold ``SHARD_ROWS`` documents on average whatever the input's size, and a
hash of the id deals a source's documents over all of them, so memory is bounded
and no source gathers in a task. Each row carries numbers only, no text.

Edge cases: documents without tokens give one row with a null bin; a null source
or cluster conflicts with nothing; rows repeated under one id are packed each, and
kept apart where they share a cluster; ties go by id, source, cluster and piece;
an empty table gives no rows. Columns beyond those named are not read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, word_count

CAPACITY = 2048
SHARD_ROWS = 4096
SCHEMA = ("doc_id long, piece int, token_start long, n_tokens long, bin_id long, position int, "
          "bin_tokens long")


class Bins:
    """Bins ordered by residual. ``present`` has a bit per residual in use; a level
    also keeps the sources common to all its bins, to be passed over at once."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels: dict[int, list[int]] = defaultdict(list)
        self.common: dict[int, int] = {}
        self.present = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.count: list[int] = []

    def open(self, size: int, source: int, cluster: int) -> int:
        self.sources.append(source)
        self.clusters.append(cluster)
        self.used.append(size)
        self.count.append(1)
        self._insert(len(self.used) - 1)
        return len(self.used) - 1

    def _insert(self, b: int) -> None:
        left = self.capacity - self.used[b]
        level = self.levels[left]
        self.common[left] = self.sources[b] & (self.common[left] if level else -1)
        insort(level, b)
        self.present |= 1 << left

    def _remove(self, b: int) -> None:
        left = self.capacity - self.used[b]
        level = self.levels[left]
        level.remove(b)
        if not level:
            self.present &= ~(1 << left)
        else:
            self.common[left] = -1
            for other in level:
                self.common[left] &= self.sources[other]

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The first compatible bin, by residual and then by age."""
        rest = self.present >> size
        left = size
        while rest:
            skip = (rest & -rest).bit_length() - 1
            left, rest = left + skip, rest >> skip + 1
            if not self.common[left] & source:
                for b in self.levels[left]:
                    if not self.sources[b] & source and not self.clusters[b] & cluster:
                        return b
            left += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, position in it)."""
        b = self.tightest(size, source, cluster)
        if b is None:
            return self.open(size, source, cluster), 0
        self._remove(b)
        self.used[b] += size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.count[b] += 1
        self._insert(b)
        return b, self.count[b] - 1


def bits(values: list) -> list[int]:
    """One bit per distinct value that occurs twice or more; none for the others,
    which can conflict with nothing."""
    often = {v for v, n in Counter(values).items() if n > 1 and v is not None}
    place: dict = {}
    return [1 << place.setdefault(v, len(place)) if v in often else 0 for v in values]


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, piece, token_start, n_tokens, bin, position, bin_tokens) for rows of
    (doc_id, source, cluster, n_tokens)."""
    order = sorted(rows, key=lambda r: (-(r[3] % capacity), r[0] is None, r[0] or 0, r[1] is None,
                                        r[1] or "", r[2] is None, r[2] or 0, r[3]))
    sources, clusters = bits([r[1] for r in order]), bits([r[2] for r in order])
    bins, placed = Bins(capacity), []
    for (doc, _, _, n), s, c in zip(order, sources, clusters):
        if n == 0:
            placed.append((doc, 0, 0, 0, None, None))
        elif n % capacity:
            placed.append((doc, n // capacity, n - n % capacity, n % capacity,
                           *bins.put(n % capacity, s, c)))
    at = len(bins.used)
    out = [(*p, None if p[4] is None else bins.used[p[4]]) for p in placed]
    for doc, _, _, n in order:
        for k in range(n // capacity):
            out.append((doc, k, k * capacity, capacity, at, 0, capacity))
            at += 1
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``items`` (doc_id, source, cluster,
    n_tokens): the tokens it covers, its bin and its place there."""
    items = durable(items.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                                 F.col("cluster").cast("long").alias("cluster"),
                                 F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")))
    shards = max(1, math.ceil(items.count() / SHARD_ROWS))

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rows = list(zip(*[t.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens")]))
        out = pack_shard(rows, capacity)
        cols = list(zip(*out))
        cols[4] = [None if b is None else shard << 32 | b for b in cols[4]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    # Salted by the row's numbers, so that rows repeated under one id spread too.
    shard = F.pmod(F.xxhash64("doc_id", "source", "n_tokens", F.rand(17)), F.lit(shards))
    return items.withColumn("shard", shard).groupBy("shard").applyInArrow(run, SCHEMA)


def as_items(docs: DataFrame) -> DataFrame:
    """Documents as items: words as tokens, equal lower-case texts as clusters."""
    w = word_count("text")
    cluster = F.when(w > 0, F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))))
    return docs.select("doc_id", "source", cluster.alias("cluster"), w.alias("n_tokens"))
