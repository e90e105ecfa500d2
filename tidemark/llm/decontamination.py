"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are lower-cased in A-Z and cut into words of digits, letters and characters
beyond ASCII. A window is ten consecutive words of an item; an item of fewer words,
but not none, is one window. Items are dealt into blocks of a bounded number of
words, by a hash, so that copies of an item spread; a task builds one automaton for
each block. Documents stream through every block's automaton: for each word the
longest match that ends there is known, and with it every window that ends there.
Only runs of words whose neighbouring pairs all occur in items are streamed; a match
of two words or more cannot leave such a run.

An automaton holds at most two states and three transitions a word, so a block has a
proven size; blocks are broadcast one at a time and documents pass through them
without a shuffle, however many items there are.

Defined results: null and empty texts have no words and no hits. An item repeated
under one id is one item with the windows of all its rows; an item without id marks
words, but is not named or counted. Documents may repeat or lack ids: each row is
judged alone. An empty benchmark hits nothing, empty documents give no row. Extra
columns are carried along by ``scan`` and ``decontaminate``; columns named like the
added ones are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Words of a window.
WINDOW = 10
#: Words of items in one block, and words of an item in one piece; a longer item is
#: cut into pieces that overlap by a window less one word.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
#: Blocks a row passes between two written tables.
BLOCKS_A_PASS = 4

_KEPT = rb"[0-9a-z\x80-\xff]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


# ---- the automaton of one block --------------------------------------------

@dataclass
class Automaton:
    """Suffix automaton over word numbers. ``step`` maps state * size + word to the
    next state; ``windows`` and ``shorts`` tell whose windows end in a state."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def build(self, items: Sequence[tuple[str | None, list[bytes], bool]]) -> Automaton:
        """Add items (id, words, whole): a whole item shorter than a window counts as one."""
        nexts: list[dict[int, int]] = [{}]
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws, _ in items]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(nexts, last, c)
        self.size = len(self.vocabulary)
        self.step = {s * self.size + c: t for s, out in enumerate(nexts) for c, t in out.items()}
        named: dict[int, set[str]] = {}
        short: dict[tuple[int, int], set[str]] = {}
        for (name, _, whole), text in zip(items, texts):
            own = set() if name is None else {name}
            if len(text) < WINDOW and not whole:
                continue
            v = held = 0
            for c in text:
                v, held = self.step[v * self.size + c], held + 1
                if held >= WINDOW:
                    while self.length[self.link[v]] >= WINDOW:
                        v = self.link[v]
                    held = WINDOW
                    named.setdefault(v, set()).update(own)
            if 0 < len(text) < WINDOW:
                short.setdefault((v, len(text)), set()).update(own)
        self.named = {s: sorted(ids) for s, ids in named.items()}
        self.short: dict[int, list[tuple[int, list[str]]]] = {}
        for (s, m), ids in sorted(short.items()):
            self.short.setdefault(s, []).append((m, sorted(ids)))
        self.window_state, self.marked = [0] * len(self.link), [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.window_state[s] = (s if self.length[up] < WINDOW else self.window_state[up]) if self.length[s] >= WINDOW else 0
            self.marked[s] = s if s in self.short else self.marked[up]
        pairs = {a * self.size + b for text in texts for a, b in zip(text, text[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.least = min([WINDOW, *(m for _, m in short)])
        return self

    def _extend(self, nexts: list[dict[int, int]], last: int, c: int) -> int:
        link, length = self.link, self.length
        if (q := nexts[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(nexts, last, c, q)
        link.append(0)
        length.append(length[last] + 1)
        nexts.append({})
        new, p = len(link) - 1, last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(nexts, p, c, q)
        return new

    def _split(self, nexts: list[dict[int, int]], p: int, c: int, q: int) -> int:
        """The part of state q as short as p plus c, as a state of its own."""
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        nexts.append(dict(nexts[q]))
        part = len(self.link) - 1
        self.link[q] = part
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = part
            p = self.link[p]
        return part

    def numbers(self, ws: list[bytes]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, -1) for w in ws]

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches [start, end) of known words all of whose neighbouring
        pairs occur in items, as long as the shortest window at least."""
        if not len(ids) or not self.size:
            return []
        good = ids >= 0
        joined = np.zeros(len(ids) + 1, dtype=bool)                      # joined[i]: i - 1 and i belong together
        if len(ids) > 1 and len(self.pairs):
            codes = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined[1:-1] = (self.pairs[at] == codes) & good[:-1] & good[1:]
        starts = np.flatnonzero(good & ~joined[:-1])
        ends = np.flatnonzero(good & ~joined[1:]) + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def matches(self, ids: list[int], start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(position, longest match ending there, state, longest window ending there)
        of one run, wherever a window ends."""
        step, link, length, size = self.step, self.link, self.length, self.size
        v = held = 0
        for i in range(start, end):
            c = ids[i]
            while (t := step.get(v * size + c)) is None and v:
                v = link[v]
                held = length[v]
            v, held = (0, 0) if t is None else (t, held + 1)
            reach = WINDOW if held >= WINDOW else 0
            if not reach and (s := self.marked[v]):
                fit = [m for m, _ in self.short[s] if m <= held]
                if not fit and (s := self.marked[link[s]]):
                    fit = [m for m, _ in self.short[s]]
                reach = max(fit, default=0)
            if reach:
                yield i, held, v, reach

    def found(self, held: int, v: int) -> Iterator[tuple[int, int]]:
        """Keys of the windows that end with a match: (state, 0) or (state, words)."""
        if held >= WINDOW:
            yield self.window_state[v], 0
        s = self.marked[v]
        while s:
            for m, _ in self.short[s]:
                if m <= held:
                    yield s, m
            s = self.marked[self.link[s]]

    def names(self, key: tuple[int, int]) -> list[str]:
        s, m = key
        return self.named.get(s, []) if m == 0 else next(ids for n, ids in self.short[s] if n == m)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Union of spans (start, end, longest match) that overlap or touch, by start."""
    out: list[tuple[int, int, int]] = []
    for a, b, m in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(m, out[-1][2]))
        else:
            out.append((a, b, m))
    return out


# ---- distributed part -------------------------------------------------------

def blocks(spark: SparkSession, items: DataFrame) -> tuple[DataFrame, int]:
    """A durable table (block, automaton) of the items (item_id, text), and its size."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist()):
                ws = words(text)
                for lo in range(0, len(ws), PIECE_WORDS):
                    piece = ws[lo:lo + PIECE_WORDS + WINDOW - 1]
                    rows.append((name, b" ".join(piece), len(ws) < WINDOW, len(piece)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.bool_(), pa.int64()))],
                                             ["name", "piece", "whole", "n"])

    pieces = durable(items.select(F.col("item_id").cast("string").alias("name"), "text")
                     .mapInArrow(cut, "name string, piece binary, whole boolean, n long").distinct())
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // BLOCK_WORDS)

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("piece", "name", "whole"))), key=lambda r: (r[0], r[1] or "", r[2]))
        made = Automaton().build([(name, piece.split(b" "), whole) for piece, name, whole in rows])
        return pa.table({"block": group.column("block")[:1], "automaton": [pickle.dumps(made.__dict__)]})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("piece", "name"), F.lit(max(n_blocks, 1))).cast("long"))
    built = durable(dealt.groupBy("block").applyInArrow(build, "block long, automaton binary"))
    return built, n_blocks


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with ``n_words``, ``hits`` (merged spans of word numbers with the
    longest match in each) and ``items`` (ids of items with occurring windows)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*own, F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start:int,end:int,longest:int>>").alias("hits"),
                      F.array().cast("array<string>").alias("items"))
    built, n_blocks = blocks(spark, items)
    done = 0
    for block in range(n_blocks):
        row = built.where(F.col("block") == block).select("automaton").first()    # one block, of bounded size
        if row is None:                                                           # no piece fell into it
            continue
        out = _through(out, spark.sparkContext.broadcast(bytes(row["automaton"])))
        done += 1
        if done % BLOCKS_A_PASS == 0 and block + 1 < n_blocks:
            out = durable(out)
    return out if done else _through(out, spark.sparkContext.broadcast(pickle.dumps(Automaton().build([]).__dict__)))


def _through(docs: DataFrame, shipped) -> DataFrame:
    """One block: adds its hits and items to the columns."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton()
        a.__dict__.update(pickle.loads(shipped.value))
        for b in batches:
            n_words, hits, items = [], [], []
            old_hits, old_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            for at, text in enumerate(b.column("text").to_pylist()):
                ids = a.numbers(words(text))
                n_words.append(len(ids))
                new, keys = [], set()
                for start, end in a.runs(np.array(ids, dtype=np.int64)):
                    for i, held, v, reach in a.matches(ids, start, end):
                        new.append((i + 1 - reach, i + 1, held))
                        keys.update(a.found(held, v))
                if new:
                    before = [(h["start"], h["end"], h["longest"]) for h in old_hits[at]]
                    hits.append([dict(zip(("start", "end", "longest"), s)) for s in merged(before + new)])
                    items.append(sorted({name for k in keys for name in a.names(k)} | set(old_items[at])))
                else:
                    hits.append(old_hits[at])
                    items.append(old_items[at])
            kept = [b.column(c) for c in b.schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(hits, spans_type),
                                              pa.array(items, pa.list_(pa.string()))], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, words inside windows, items met and a verdict."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"]).cast("long"))
    return scan(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Documents without contaminated spans. A span goes if a match in it has
    ``longest`` words or more; all spans of a document go if they cover more than
    ``coverage`` of its words. Text outside stays byte for byte."""
    found = scan(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for at, (n, hits) in enumerate(zip(b.column("n_words").to_pylist(), b.column("hits").to_pylist())):
                covered = sum(h["end"] - h["start"] for h in hits)
                gone = [h for h in hits if h["longest"] >= longest or covered > coverage * n]
                if gone:
                    raw = texts[at].encode("utf-8", "surrogatepass")
                    places = [m.span() for m in re.finditer(_KEPT, raw.translate(_FOLD))]
                    out, upto = [], 0
                    for h in gone:
                        out.append(raw[upto:places[h["start"]][0]])
                        upto = places[h["end"] - 1][1]
                    texts[at] = b"".join([*out, raw[upto:]]).decode("utf-8", "surrogatepass")
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return found.mapInArrow(run, found.schema)
