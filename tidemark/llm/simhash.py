"""SimHash near-dedup with vantage-point partitions.

A document's 64-bit fingerprint takes the majority of each bit over the XXH64
hashes of its word shingles. Fingerprints link when at most ``radius`` bits
differ, and documents of linked fingerprints form a component.

Links are found exactly. A vantage-point tree splits the distinct fingerprints:
at a node with vantage v and bound m, a fingerprint at distance d from v goes to
the near side if d <= m + radius and to the far side if d > m. By the triangle
inequality two fingerprints within the radius always share a side, so a branch is
left out only where no partner can be; those between m and m + radius overlap and
go to both. The upper levels of the tree make shards, one group each; inside a
shard the same rule recurses down to leaves, which compare in blocks.

Within a leaf only a spanning forest of the links is kept, so a ball of thousands
of near copies gives as many rows as it has members, and components stay whole.

At a similarity of 0.8 a text of some sixty words differs from its near copy by 5 to
10 of 64 bits. A radius of that size leaves a vantage point nothing to prune, since
random fingerprints lie 32 +- 4 bits apart. ``keep_first`` therefore follows the
vantage-point search by ``near_copies``: bands of min-hashes over five-word shingles
name candidates, and every link is verified on the whole sets of shingles.

Edge cases: a null or empty text, or one of white space alone, has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of all
of them; repeated rows of one id each get a row; rows with a null id get a
fingerprint but never name a component unless all members have null ids, where it
is null; an empty table gives no rows. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import stored
from tidemark.llm.common import attach, durable
from tidemark.llm.components import components

SEED = 42
#: Fingerprints that the shards' tree is drawn from: a bounded sample.
TREE_SAMPLE = 20_000
#: Fingerprints a shard holds, about, and a leaf at most (where it still splits).
SHARD_ROWS = 50_000
LEAF_ROWS = 384
HASHES_AT_ONCE = 1 << 16
#: Near copies: words of a shingle, similarity, min-hashes of a band, bands. A pair at
#: the similarity shares a band with probability 0.998.
COPY_SIZE = 5
COPY_SIMILARITY = 0.8
BAND_ROWS = 6
BANDS = 20
MINIMA_AT_ONCE = 4096
#: Ids (16 bytes each in a hash table) that are broadcast at most; beyond, both sides
#: are shuffled.
BROADCAST_IDS = 500_000
#: Rounds in which a few members of a band's group meet all others, and shingles that
#: a block of the groups left after them holds, about.
ROUNDS = 2
BLOCK_SHINGLES = 200_000


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased (A-Z) ``size``-word shingles, repeats included, in
    arrays of at most HASHES_AT_ONCE; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest as xxh
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    n = max(1, len(words) - size + 1)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:n - 1].tolist()]
    stops = (ends[len(words) - n:] - 1).tolist()
    for at in range(0, n, HASHES_AT_ONCE):
        yield np.array([xxh(flat[s:e], SEED) for s, e in
                        zip(begins[at:at + HASHES_AT_ONCE], stops[at:at + HASHES_AT_ONCE])], "<u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles, repeats included; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()),
                                              pa.array(fp, pa.int64())], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, fp long")


def distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def vantage(x: np.ndarray, radius: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, its bound and all distances; None where no split helps.

    Of a few candidates the one whose larger side is smallest is taken. The
    choice affects speed alone."""
    best = None
    for v in x[:: max(1, len(x) // 5)][:5]:
        d = distance(x, v)
        upto = np.cumsum(np.bincount(d, minlength=65 + radius))
        for m in range(64):
            larger = max(int(upto[m + radius]), len(x) - int(upto[m]))
            if best is None or larger < best[0]:
                best = (larger, v, m, d)
    if best is None or best[0] > 0.95 * len(x):
        return None
    return best[1], best[2], best[3]


def sides(x: np.ndarray, d: np.ndarray, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return d <= m + radius, d > m


def grow(sample: np.ndarray, depth: int, radius: int) -> list:
    """The shards' tree: nested [vantage, bound, near, far]; a leaf is []."""
    split = vantage(sample, radius) if depth and len(sample) > 8 else None
    if split is None:
        return []
    v, m, d = split
    near, far = sides(sample, d, m, radius)
    return [int(v), m, grow(sample[near], depth - 1, radius), grow(sample[far], depth - 1, radius)]


def shards(x: np.ndarray, tree: list, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) for each shard that any of ``x`` overlaps."""
    stack = [(tree, np.arange(len(x)), 1)]
    while stack:
        node, at, name = stack.pop()
        if not len(at):
            continue
        if not node:
            yield name, at
            continue
        near, far = sides(x[at], distance(x[at], np.uint64(node[0])), node[1], radius)
        stack += [(node[2], at[near], 2 * name), (node[3], at[far], 2 * name + 1)]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions in ``x``) whose components are those of all pairs within
    the radius. ``x`` holds distinct fingerprints of one shard."""
    parent = np.arange(len(x))
    out = []
    stack = [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) < 2:
            continue
        split = vantage(x[at], radius) if len(at) > LEAF_ROWS else None
        if split is not None:
            near, far = sides(x[at], split[2], split[1], radius)
            stack += [at[near], at[far]]
            continue
        for lo in range(0, len(at), LEAF_ROWS):
            rows = at[lo:lo + LEAF_ROWS]
            for start in range(lo, len(at), LEAF_ROWS):
                cols = at[start:start + LEAF_ROWS]
                i, j = np.nonzero(distance(x[rows][:, None], x[cols][None, :]) <= radius)
                for a, b in zip(rows[i].tolist(), cols[j].tolist()):
                    if a < b or start > lo:
                        ra, rb = find(parent, a), find(parent, b)
                        if ra != rb:
                            parent[max(ra, rb)] = min(ra, rb)
                            out.append((a, b))
    return out


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are
    those of all pairs within ``radius`` bits."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD_ROWS)) / np.log2(1.6))))
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE)
                       .collect()], np.int64).view(np.uint64) if depth else np.empty(0, np.uint64)
    tree = grow(sample, depth, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for name, at in shards(fp.view(np.uint64), tree, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), name, np.int64)), pa.array(fp[at])], ["shard", "fp"])

    def search(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").to_numpy())
        pairs = np.array(forest(fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fp[pairs[:, 0]]), "b": pa.array(fp[pairs[:, 1]])})

    return distinct.select("fp").mapInArrow(deal, "shard long, fp long").groupBy(
        "shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; ``component_id`` is the
    smallest doc_id reachable over links."""
    marked = durable(fingerprints(docs, size))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = durable(components(durable(links(distinct, radius))))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    first = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = durable(attach(grouped, first, ["component"], "inner").select("fp", "component_id"))
    return attach(marked, named, ["fp"], "inner").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the min-hash functions, one row each."""
    from xxhash import xxh64_intdigest as xxh
    draw = [np.array([[xxh(f"{name}{k}", SEED)] for k in range(BANDS * BAND_ROWS)], np.uint64)
            for name in "ab"]
    return draw[0] | np.uint64(1), draw[1]


def band_keys(hashes: np.ndarray, factor: np.ndarray, summand: np.ndarray) -> list[int]:
    """Keys of the bands, each a hash of the band's number and minima."""
    from xxhash import xxh64_intdigest as xxh
    low = np.full(len(factor), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), MINIMA_AT_ONCE):
        low = np.minimum(low, (hashes[None, at:at + MINIMA_AT_ONCE] * factor + summand).min(axis=1))
    keys = [xxh(low[k * BAND_ROWS:(k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bands(docs: DataFrame, size: int = COPY_SIZE) -> DataFrame:
    """(doc_id, n, keys) of rows with an id and a word: number of distinct shingles
    and the keys of the bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = permutations()
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                h = shingle_set(t.as_py(), size)
                if len(h):
                    rows.append((d, len(h), band_keys(h, *draw)))
            ids, n, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "keys"])
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, size: int = COPY_SIZE) -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(t.as_py(), size).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    ["doc_id", "shingles"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, shingles array<long>")


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id is in the durable ``ids`` (one long column).
    They are counted, and texts stay where they are while the ids fit the bound."""
    ids = ids.toDF("_id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    sets = among(sets, durable(pairs.select(F.explode(F.array("a", "b"))).distinct()))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def forest_of_sets(ids: np.ndarray, component: np.ndarray, flat: np.ndarray, ends: np.ndarray,
                   similarity: float) -> list[tuple[int, int]]:
    """Links (positions in ``ids``) whose components, with those given, are those of all
    pairs of a Jaccard similarity of at least that. ``flat`` holds the sets one by one."""
    sizes = np.diff(np.append(0, ends))
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(flat, kind="stable")
    post = owner[order]                                                   # owners by shingle, ascending
    new = np.append(True, flat[order][1:] != flat[order][:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(post))
    which = np.empty(len(flat), np.int64)
    which[order] = group
    parent = np.unique(component, return_index=True, return_inverse=True)
    parent = parent[1][parent[2]]                                         # the first member of each component
    out = []
    for x in range(1, len(ids)):
        mine = which[ends[x] - sizes[x]:ends[x]]
        begin, long = first[mine], last[mine] - first[mine]
        at = np.repeat(begin - np.append(0, np.cumsum(long)[:-1]), long) + np.arange(long.sum())
        common = np.bincount(post[at], minlength=len(ids))[:x]
        for y in np.flatnonzero((common > 0) & (common >= similarity * (sizes[x] + sizes[:x] - common) - 1e-9)).tolist():
            rx, ry = find(parent, x), find(parent, y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out


def links_in_groups(state: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members of a band's group that make one component of all
    members that are linked. Each group is cut into blocks of bounded size, and each two
    blocks meet in one task, where pairs are counted and only a forest leaves it. So a
    group of one block sends a row per member."""
    run = Window.partitionBy("key").orderBy("doc_id")
    upto = F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = state.select("key", "doc_id", "component", "n", F.floor(upto / BLOCK_SHINGLES).alias("block"))
    most = placed.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    dealt = attach(placed, most, ["key"], "inner").withColumn("other", F.explode("blocks")).select(
        "key", "doc_id", "component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, component = (t.column(c).to_numpy() for c in ("doc_id", "component"))
        found = []
        if len(ids) > 1:
            lists = t.column("shingles").combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            found = forest_of_sets(ids, component, flat, ends, similarity)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})

    needed = among(sets, durable(state.select("doc_id").distinct()))
    return dealt.join(needed, "doc_id").groupBy("key", "lo", "hi").applyInArrow(search, "a long, b long")


def near_copies(docs: DataFrame, only: DataFrame, similarity: float = COPY_SIMILARITY,
                size: int = COPY_SIZE) -> DataFrame:
    """(doc_id, component_id) of documents linked to another: links are the pairs
    that share a band and whose shingle sets are that similar. ``only`` holds the
    doc_ids to look at, each of one text.

    In each of ``ROUNDS`` a few members of a band's group, four times as many as in the
    round before, meet all others of another component, are verified, and leave the group.
    A group is done when those left are of one component; so most groups of copies cost as
    many pairs as they have members. Of groups that are left, such as those of many texts
    that are all like one and unlike each other, every pair is compared within tasks
    (``links_in_groups``). No pair that could join two components is left out."""
    banded = among(bands(docs, size), only.select("doc_id"))
    rows = durable(banded).select("doc_id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    state = durable(rows.join(shared, "key", "left_semi").withColumn("component", F.col("doc_id")))
    wanted = durable(state.select("doc_id").distinct())
    sets = durable(shingle_sets(among(docs, wanted), size))
    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(ROUNDS + 1):
        still = state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        state = stored(attach(state, still.where("lo < hi").drop("hi"), ["key"], "inner"), "near-state")
        if turn == ROUNDS and not state.isEmpty():
            found = stored(labels.toDF("a", "b").union(links_in_groups(state, sets, similarity)), "near-links")
            labels = stored(components(found), "near-labels")
        if turn == ROUNDS or state.isEmpty():
            return labels.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
        main = F.col("component") == F.col("lo")
        place = F.row_number().over(Window.partitionBy("key", "main").orderBy("doc_id"))
        asking = durable(state.withColumn("main", main).where(main | F.lit(turn > 0))
                         .withColumn("place", place).where(F.col("place") <= 4 ** turn)
                         .select("key", F.col("doc_id").alias("asks"), F.col("n").alias("asks_n"),
                                 F.col("component").alias("asks_component")))
        met = state.join(asking, "key").where(
            (F.col("component") != F.col("asks_component"))
            & (F.least("n", "asks_n") >= similarity * F.greatest("n", "asks_n") - 1e-9))
        pairs = durable(met.select(F.greatest("doc_id", "asks").alias("a"),
                                   F.least("doc_id", "asks").alias("b")).distinct())
        found = stored(labels.union(verified(pairs, sets, similarity)).toDF("a", "b"), "near-links")
        labels = stored(components(found), "near-labels")
        left = state.join(asking.select("key", F.col("asks").alias("doc_id")), ["key", "doc_id"], "left_anti")
        state = attach(left.drop("component", "lo").withColumn("node", F.col("doc_id")), labels, ["node"]
                       ).drop("node").withColumn("component", F.coalesce("component", "doc_id"))


def keep_first(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """One document of each near-duplicate group: the rows of ``docs`` whose id names
    their component, by fingerprints and then by ``near_copies``, and all rows without
    an id. Of rows repeated with one id and text one stays; ids of several texts stay
    out of the second step."""
    seen = near_duplicates(docs, radius, size).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("first"),
        (F.min("fp") == F.max("fp")).alias("one"), (F.count(F.lit(1)) > 1).alias("repeated"))
    kept = durable(seen.where("first").select("doc_id", "one", "repeated"))
    copies = near_copies(docs.select("doc_id", "text"), kept.where("one")).where("doc_id <> component_id")
    names = durable(kept.join(copies, "doc_id", "left_anti").select("doc_id", "repeated"))
    once = among(docs, names.where("NOT repeated").select("doc_id"))
    again = among(docs, names.where("repeated").select("doc_id")).dropDuplicates(["doc_id", "text"])
    return once.union(again).union(docs.where("doc_id IS NULL"))
