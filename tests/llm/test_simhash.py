import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def plain(text):
    """The fingerprint bit by bit."""
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(ids, fps, radius=3):
    comp = list(range(len(fps)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [best.get(root(i)) for i in range(len(fps))]


def docs(n, seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["ÉTÉ", "Öl"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 40, 200]))))
            for i in range(n)]
    base = rows[7][1]
    for i in range(n, n + 60):                      # near copies, chained
        w = base.split()
        w[rnd.randrange(len(w))] = rnd.choice(vocab)
        base = " ".join(w)
        rows.append((i, base))
    return rows + [(n + 61, None), (n + 62, ""), (n + 63, " \t\n"), (n + 64, rows[3][1]),
                   (n + 64, rows[3][1]), (None, rows[3][1]), (None, "alone here"),
                   (n + 65, "the same " * 40_000)]


@pytest.mark.parametrize("shard_rows,leaf", [(50_000, 384), (40, 8)])
def test_components_equal_brute_force(spark, corpus, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    rows = docs(150)
    df = corpus(rows).withColumnRenamed("n_chars", "fp")          # a clashing extra column
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id)
                 for r in simhash.near_duplicates(df).collect())
    fps = [plain(t) for _, t in rows]
    want = brute([i for i, _ in rows], fps)
    key = [(i if i is not None else -1, f, c) for (i, _), f, c in zip(rows, fps, want)]
    assert got == sorted(key, key=lambda r: (r[0], r[1]))


def test_forest_keeps_components_of_close_balls():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
                                  ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
                                  for s in seeds]))
    links = simhash.forest(x, 3)
    assert len(links) < len(x)
    want = brute(list(range(len(x))), [int(v) for v in x])
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        assert (int(x[a]) ^ int(x[b])).bit_count() <= 3
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(i) for i in range(len(x))] == want


def test_empty_table(spark, corpus):
    assert simhash.near_duplicates(corpus([])).count() == 0
