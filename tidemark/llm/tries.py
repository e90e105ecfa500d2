"""Prefix trie of conversations with subtree totals by time-forward processing.

A turn is a digest of its role and text; a prefix is the sum of its digests times
powers of a base modulo the prime 2^127 - 1, so prefixes of turns that lie in several
tasks add up, and no task needs a whole conversation. Equal depth and sum mean equal
prefixes.

Every node belongs to its smallest member, so the trie falls into chains: the nodes
of one conversation below the node where it leaves a smaller one. The places at which
a path changes chains, written as (depth from the deepest, next conversation), give a
key whose string order is a post-order of the nodes. Ranges of keys are the shards.
Within a shard nodes are sorted by falling depth and hand their totals to their
parents through a priority queue that writes runs beyond a bound. What is left in the
queue is for parents in other shards: these, far fewer, form a tree of their own, in
which the parent of a node is the first ancestor beyond its shard. The same job solves
that tree, and its totals enter the shards in a second pass.

Defined results: rows without conv_id take no part. Null role or text is empty. Turns
with equal number follow the order of their digests; repeated rows are turns of their
own. Negative ids work. No conversations give no node, not even a root. Extra columns
are ignored. Role and text are joined with the role's length in front, so their border
counts. A conversation may hold any share of all turns: its path is two numbers and a
sum for each turn, and its chain is cut into shards like any other.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, attach, attach_counted, durable

PRIME, BASE = 2 ** 127 - 1, 0x5DEECE66D1F3A9B7C4E21D0B8A967F35
#: Shared turns at most, and conversations with one common start.
HEADS, KIN = 9, 5
#: Nodes of a shard aimed at, most shards, messages a queue holds in memory.
SHARD_NODES, MOST_SHARDS, QUEUE_ITEMS = 25_000, 20_000, 200_000
#: Text of one piece of a node's list of ends.
CHUNK_CHARS = 65_536
SEGMENT, LAST = 24, "g" * 16


# ---- rebuilt paths ----------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, sum, n_bytes): turns in order with the digest sum up to each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("conv"), "turn", F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    cut = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("part", F.spark_partition_id())
                  .mapInArrow(_local_sums, "conv long, part int, pos long, sum binary, n_bytes long, edge boolean"))
    shift: dict[tuple[int, int], tuple[int, int]] = {}
    at, n, total = None, 0, 0
    edges = cut.where("edge").select("conv", "part", "pos", "sum").collect()        # two a task at most
    for r in sorted(edges, key=lambda r: (r["conv"], r["part"])):
        n, total = (n, total) if r["conv"] == at else (0, 0)
        at = r["conv"]
        if n:
            shift[r["conv"], r["part"]] = n, total
        total = (total + pow(BASE, n, PRIME) * int.from_bytes(r["sum"])) % PRIME
        n += r["pos"]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, pos, sums = b.column("conv").to_pylist(), b.column("pos").to_pylist(), b.column("sum").to_pylist()
            for i, k in enumerate(zip(conv, b.column("part").to_pylist())):
                if (s := shift.get(k)) is not None:
                    sums[i] = ((s[1] + pow(BASE, s[0], PRIME) * int.from_bytes(sums[i])) % PRIME).to_bytes(16)
                    pos[i] += s[0]
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(pos, pa.int64()), pa.array(sums, pa.binary()),
                                              b.column("n_bytes")], ["conv", "pos", "sum", "n_bytes"])

    schema = "conv long, pos long, sum binary, n_bytes long"
    return cut.mapInArrow(moved, schema) if shift else cut.select("conv", "pos", "sum", "n_bytes")


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and sums within a task's range. The last row of its first and of its
    last conversation is an edge; one row is held back, since only its successor tells."""
    names = ["conv", "part", "pos", "sum", "n_bytes", "edge"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    at, first, pos, power, total, held = None, True, 0, 1, 0, None
    out: list[tuple] = []
    for b in batches:
        for conv, part, digest, n in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "digest", "n_bytes"))):
            if held is not None:
                out.append((*held, first and conv != at))
                first = first and conv == at
            if conv != at:
                at, pos, power, total = conv, 0, 1, 0
            pos += 1
            power = power * BASE % PRIME
            total = (total + power * (int.from_bytes(digest) % PRIME)) % PRIME
            held = (conv, part, pos, total.to_bytes(16), n)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*held, True), kinds)], names)


def rebuilt(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv, depth, sum, n_bytes) of rebuilt conversations, and (conv, size):
    the first h turns of the conversation that starts each kin of five, then the own
    turns after the first h."""
    head = F.when(F.col("pos") < HEADS, F.struct("pos", "sum", "n_bytes"))
    heads = durable(turned.groupBy("conv").agg(F.max("pos").alias("own"), F.sort_array(F.collect_list(head)).alias("head")))
    base = F.col("conv") - F.col("conv") % KIN
    starts = heads.where(F.col("conv") % KIN == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_own"),
                                                          F.col("head").alias("base_head"))
    h = F.when(F.col("conv") % KIN == 0, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    plan = (heads.withColumn("base", base).join(starts, "base", "left").withColumn("h", h.cast("int"))
            .withColumn("m", F.least("h", F.coalesce("base_own", F.lit(0))).cast("int")))
    zero = F.lit(bytes(16))
    taken = F.slice("base_head", 1, F.col("m"))
    plan = durable(plan.select(
        "conv", "h", "m", F.when(F.col("m") > 0, taken).alias("taken"),
        F.when(F.col("m") > 0, F.element_at("base_head", F.greatest("m", F.lit(1)))["sum"]).otherwise(zero).alias("start"),
        F.when((F.col("h") > 0) & (F.col("own") >= F.col("h")),
               F.try_element_at("head", F.greatest("h", F.lit(1)))["sum"]).otherwise(zero).alias("gone"),
        (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    shared = plan.where("m > 0").select("conv", F.inline("taken")).select(
        "conv", F.col("pos").alias("depth"), "sum", "n_bytes")
    own = attach_counted(turned, plan.select("conv", "h", "m", "start", "gone"), ["conv"], "inner").where("pos > h")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = {k: pow(BASE, k, PRIME) for k in range(-HEADS, 1)}
        for b in batches:
            depths, sums = [], []
            for pos, s, h, m, start, gone in zip(*(b.column(c).to_pylist() for c in ("pos", "sum", "h", "m", "start", "gone"))):
                depths.append(pos - h + m)
                sums.append(s if h == 0 else ((int.from_bytes(start) + (int.from_bytes(s) - int.from_bytes(gone)) * factors[m - h])
                                              % PRIME).to_bytes(16))
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(depths, pa.int64()), pa.array(sums, pa.binary()),
                                              b.column("n_bytes")], ["conv", "depth", "sum", "n_bytes"])

    paths = shared.unionByName(own.mapInArrow(moved, "conv long, depth long, sum binary, n_bytes long"))
    return durable(paths), plan.select("conv", "size")


# ---- chains and keys --------------------------------------------------------

def _written(depth: Column, conv: Column | str) -> Column:
    conv = F.lit(conv) if isinstance(conv, str) else F.lpad(F.hex(conv), 16, "0")
    return F.concat(F.lower(F.lpad(F.hex(F.lit(2 ** 32 - 1) - depth), 8, "0")), F.lower(conv))


def written(depth: int, conv: str) -> str:
    return f"{2 ** 32 - 1 - depth:08x}{conv}"


def depth_in(segment: str) -> int:
    return 2 ** 32 - 1 - int(segment[:8], 16)


def above(key: str) -> str | None:
    """Key of a node's parent."""
    depth, chain = depth_in(key[-SEGMENT:]), key[:-SEGMENT]
    if chain and depth == depth_in(chain[-SEGMENT:]) + 1:
        return chain[:-SEGMENT] + written(depth - 1, LAST)
    return chain + written(depth - 1, LAST) if depth else None


def meeting(a: str, b: str) -> str:
    """Key of the deepest common ancestor of two nodes, or of that which is one."""
    k = 0
    while a[k:k + SEGMENT] == b[k:k + SEGMENT]:
        k += SEGMENT
    return a[:k] + written(min(depth_in(a[k:k + SEGMENT]), depth_in(b[k:k + SEGMENT])), LAST)


def nodes(paths: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, up, depth, leaves, saved, conv_id, parent_conv_id, n_convs) and
    the ends (conv_id, depth, conv)."""
    root = sizes.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    found = durable(paths.groupBy("depth", "sum").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"),
                                                      F.min("n_bytes").alias("n_bytes")))
    common = found.where("n_convs > 1").select("depth", "sum", "conv_id")
    owned = attach_counted(paths.select("conv", "depth", "sum"), common, ["depth", "sum"])
    runs = owned.groupBy("conv", F.coalesce("conv_id", "conv").alias("owner")).agg(F.max("depth").alias("upto"))
    steps = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("upto", "owner"))).alias("steps"))
    first = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(root["conv"]).cast("long").alias("owner"))
    steps = attach(sizes, steps, ["conv"]).withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<upto:long,owner:long>>")))
    steps = durable(steps.withColumn("steps", F.when(F.try_element_at("steps", F.lit(1))["owner"] == root["conv"], F.col("steps"))
                                     .otherwise(F.concat(F.array(first), F.col("steps")))))
    ends = steps.select(F.element_at("steps", -1)["owner"].alias("conv_id"), F.col("size").alias("depth"), "conv")
    before = F.slice("steps", 1, F.size("steps") - 1)
    key = F.array_join(F.transform(before, lambda s, i: _written(s["upto"], F.element_at("steps", (i + 2).cast("int"))["owner"])), "")
    chains = steps.where(F.element_at("steps", -1)["owner"] == F.col("conv")).select(
        F.col("conv").alias("conv_id"), "size", key.alias("chain"),
        F.when(F.size("steps") > 1, F.element_at(before, -1)["upto"]).otherwise(-1).alias("hangs_at"),
        F.when(F.size("steps") > 1, F.element_at(before, -1)["owner"]).alias("parent"))
    chains = durable(chains)
    crowned = chains.where("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), F.col("hangs_at").alias("size"),
                                                        F.lit(True).alias("crowned")).distinct()
    chains = durable(attach(chains, crowned, ["conv_id", "size"]))
    top = sizes.sparkSession.createDataFrame([(0, root["n"], root["conv"], 0)], "depth long, n_convs long, conv_id long, n_bytes long")
    rows = attach_counted(found.drop("sum").unionByName(top), chains, ["conv_id"], "inner")
    is_top = F.col("depth") == F.col("hangs_at") + 1
    return rows.select(
        F.concat("chain", _written(F.col("depth"), LAST)).alias("key"), "depth",
        ((F.col("depth") == F.col("size")) & F.col("crowned").isNull()).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), "conv_id",
        F.when(is_top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs"), ends


# ---- time-forward processing ------------------------------------------------

class SpillingQueue:
    """Messages (level, key, children, leaves, saved), smallest (level, key) first.
    Beyond ``most`` messages the later half goes, sorted, to a run in an unnamed
    scratch file of the task; runs are read back in pieces as their turn comes."""

    def __init__(self, most: int = QUEUE_ITEMS):
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self.heap.sort()
            half = len(self.heap) // 2
            run = self._stored(self.heap[half:])
            del self.heap[half:]
            self.spilled += 1
            self.runs.append([next(run), run])

    @staticmethod
    def _stored(messages: list[tuple]) -> Iterator[tuple]:
        f = tempfile.TemporaryFile()                   # no name: gone with the task, seen by nobody else
        for level, key, *numbers in messages:
            raw = key.encode()
            f.write(struct.pack("<qqqqi", level, *numbers, len(raw)) + raw)
        f.seek(0)

        def read() -> Iterator[tuple]:
            with f:
                while head := f.read(36):
                    level, children, leaves, saved, n = struct.unpack("<qqqqi", head)
                    yield level, f.read(n).decode(), children, leaves, saved
        return read()

    def peek(self) -> tuple | None:
        heads = [r[0] for r in self.runs]
        return min([*self.heap[:1], *heads], default=None)

    def pop(self) -> tuple:
        least = self.peek()
        if self.heap and self.heap[0] == least:
            return heapq.heappop(self.heap)
        at = next(k for k, r in enumerate(self.runs) if r[0] == least)
        following = next(self.runs[at][1], None)
        if following is None:
            del self.runs[at]
        else:
            self.runs[at][0] = following
        return least

    def take(self, level: int, key: str) -> Iterator[tuple]:
        while (m := self.peek()) is not None and (m[0], m[1]) == (level, key):
            yield self.pop()

    def missed(self, level: float, key: str) -> Iterator[tuple]:
        """Messages for nodes before the given one: not in this shard."""
        while (m := self.peek()) is not None and (m[0], m[1]) < (level, key):
            yield self.pop()


def climb(cut: DataFrame, final: bool) -> DataFrame:
    """One pass over shards. ``final``: rows with their subtree's totals, of which
    the columns children_in, leaves_in and saved_in come from other shards. Else:
    totals (shard, key, children, leaves, saved) for parents in other shards."""
    most = QUEUE_ITEMS
    kept = [c for c in cut.columns if c not in ("up", "shard", "leaves", "saved", "children_in", "leaves_in", "saved_in")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(most), None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("shard", "depth", "key", "up", "leaves", "saved",
                                                      *(("children_in", "leaves_in", "saved_in") if final else ()))]
            done, left = [], []
            for now, depth, key, up, leaves, saved, *more in zip(*cols):
                if now != shard:
                    left += [(shard, m) for m in queue.missed(float("inf"), "")]
                    shard = now
                left += [(shard, m) for m in queue.missed(-depth, key)]
                children, extra_leaves, extra_saved = more or (0, 0, 0)
                leaves, saved = leaves + extra_leaves, saved + extra_saved
                for m in queue.take(-depth, key):
                    children, leaves, saved = children + m[2], leaves + m[3], saved + m[4]
                done.append((children, leaves, saved))
                if up is not None:
                    queue.push((-depth_in(up[-SEGMENT:]), up, 1, leaves, saved))
            if final:
                sums = [pa.array(c, pa.int64()) for c in zip(*done)]
                if sums:
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *sums], [*kept, "children", "leaves", "saved"])
            elif left:
                yield packed(left)
        if not final and (left := [(shard, m) for m in queue.missed(float("inf"), "")]):
            yield packed(left)

    def packed(left: list[tuple[int, tuple]]) -> pa.RecordBatch:
        rows = []
        for (shard, key), same in groupby(left, key=lambda x: (x[0], x[1][1])):
            rows.append((shard, key, *map(sum, zip(*(m[2:] for _, m in same)))))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.int64()] * 3))],
                                          ["shard", "key", "children", "leaves", "saved"])

    given = cut.sortWithinPartitions("shard", F.desc("depth"), "key")
    if not final:
        return given.mapInArrow(run, "shard int, key string, children long, leaves long, saved long")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    return given.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in kept] + ["children long", "leaves long", "saved long"]))


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``tree`` (key, up, depth, leaves, saved, …) with children counted and leaves
    and saved summed over each subtree. ``up`` is the parent's key, null at the root;
    string order of keys is a post-order."""
    tree = durable(tree)
    n_shards = max(1, min(-(-tree.count() // SHARD_NODES), MOST_SHARDS))
    cut = durable(tree.repartitionByRange(n_shards, "key").withColumn("shard", F.spark_partition_id()))
    none = [F.lit(0).cast("long").alias(c) for c in ("children_in", "leaves_in", "saved_in")]
    if n_shards == 1:
        return climb(cut.select("*", *none), True)
    exits = durable(climb(cut, False))
    direct = durable(exits.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]))
    firsts = sorted(r["k"] for r in cut.groupBy("shard").agg(F.min("key").alias("k")).collect())      # one a shard

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            after = [bisect.bisect_right(firsts, k) for k in keys]
            ups = [meeting(k, firsts[a]) if a < len(firsts) else None for k, a in zip(keys, after)]
            depths = [depth_in(k[-SEGMENT:]) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ups, pa.string()), pa.array(depths, pa.int64()),
                                              b.column("leaves"), b.column("saved")], ["key", "up", "depth", "leaves", "saved"])

    ports = direct.mapInArrow(placed, "key string, up string, depth long, leaves long, saved long")
    solved = subtree_totals(ports).select("key", F.col("leaves").alias("leaves_in"), F.col("saved").alias("saved_in"))
    entering = durable(direct.select("key", F.col("children").alias("children_in")).join(solved, "key"))
    fed = attach_counted(cut, entering, ["key"]).fillna(0, ["children_in", "leaves_in", "saved_in"])
    return climb(fed if entering.count() <= BROADCAST_ROWS else fed.repartition(n_shards, "shard"), True)


# ---- ends and the whole -----------------------------------------------------

def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the digest of each node's ending conversations,
    in rising order, joined by commas. Ids are joined in ranges; one task reads the
    pieces of a node one after the other."""
    order = ["conv_id", "depth", "conv"]
    cut = durable(ends.repartitionByRange(*order).sortWithinPartitions(*order))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, start, text, size = None, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for conv_id, depth, conv in zip(*(b.column(c).to_pylist() for c in order)):
                if node is not None and (node != (conv_id, depth) or size > CHUNK_CHARS):
                    out.append((*node, start, ",".join(text)))
                    node = None
                if node is None:
                    node, start, text, size = (conv_id, depth), conv, [], 0
                text.append(str(conv))
                size += len(text[-1]) + 1
            if out:
                yield pieces(out)
                out = []
        if node is not None:
            yield pieces([(*node, start, ",".join(text))])

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                          ["conv_id", "depth", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for conv_id, depth, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "text"))):
                if node == (conv_id, depth):
                    sha.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (conv_id, depth), hashlib.sha256(text.encode())
            if out:
                yield digests(out)
        if node is not None:
            yield digests([(*node, sha.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))],
                                          ["conv_id", "depth", "ends_sha256"])

    return (cut.mapInArrow(joined, "conv_id long, depth long, first long, text string")
            .repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
            .mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turned = durable(turns(conversations))
    paths, sizes = rebuilt(turned)
    if sizes.isEmpty():
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, "
                                                          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows, ends = nodes(paths, sizes)

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ups = pa.array([above(k) for k in b.column("key").to_pylist()], pa.string())
            yield b.append_column("up", ups)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    totals = subtree_totals(rows.mapInArrow(raised, f"{kinds}, up string"))
    nothing = hashlib.sha256(b"").hexdigest()
    return attach_counted(totals, durable(end_digests(ends)), ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
