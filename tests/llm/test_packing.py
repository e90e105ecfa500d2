import random
from collections import defaultdict

import pytest

from tidemark.llm import packing


def naive(rows, capacity):
    """Best fit by a look at every bin."""
    bins, out = [], {}
    order = sorted(rows, key=lambda r: (-(r[3] % capacity), r[0], r[1] or "", r[2] or 0, r[3]))
    for d, s, c, n in order:
        if not n % capacity:
            continue
        fits = [(capacity - b["used"], k) for k, b in enumerate(bins)
                if b["used"] + n % capacity <= capacity and (s is None or s not in b["s"])
                and (c is None or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"used": 0, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["used"] += n % capacity
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out[d] = k
    return out


def rows(n, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot"] * 3 + ["a", "b", "c", None]), rnd.choice([None, 1, 2, rnd.randrange(10**6)]),
             rnd.choice([0, 5, 30, 64, 100, rnd.randint(1, 500)])) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_tightest_compatible_bin_equals_a_full_search(seed):
    data = rows(400, seed)
    got = {d: b for d, piece, _, n, b, *_ in packing.pack_shard(data, 100) if n and n < 100}
    assert got == {d: b for d, b in naive(data, 100).items()}


def test_every_token_once_no_conflict_no_overflow(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 100)
    data = rows(1000, 9) + [(5, "a", 7, 40)] * 3 + [(None, None, None, 12), (2000, "a", None, 123_456),
                                                    (2001, "b", 3, None)]
    df = spark.createDataFrame([(*r, "x") for r in data],
                               "doc_id long, source string, cluster long, n_tokens long, bin_id string")
    out = packing.pack(df, 100).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    want = defaultdict(int)
    for d, _, _, n in data:
        want[d] += n or 0
    assert total == want and sum(r.bin_id is None for r in out) == sum(not r[3] for r in data)
    source = {d: s for d, s, _, _ in rows(1000, 9)}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) == b[0].bin_tokens <= 100
        assert sorted(r.position for r in b) == list(range(len(b)))
        named = [source[r.doc_id] for r in b if source.get(r.doc_id) and r.doc_id != 5]
        assert len(named) == len(set(named))
        assert sum(r.doc_id == 5 for r in b) <= 1 or any(r.n_tokens == 100 for r in b)


def test_items_and_empty_table(spark, corpus):
    got = packing.as_items(corpus([(1, "A  b\nC"), (2, "a b c"), (3, None), (4, " ")])).collect()
    assert got[0].cluster == got[1].cluster and [r.n_tokens for r in got] == [3, 3, 0, 0]
    assert got[2].cluster is None and packing.pack(packing.as_items(corpus([]))).count() == 0
