import numpy as np
import pytest

from tidemark.llm import ann


def truth(vectors, every, k):
    """All distances of every query."""
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and None not in v
          and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    dim = max({len(v) for _, v in ok}, key=[len(v) for _, v in ok].count)
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q, v in ok:
        if q % every == 0:
            best = {}
            for i, u in ok:
                if i != q:
                    d = float(np.sqrt(((u - v) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def vectors(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 16))).astype(np.float32)
    x[:: 3] = x[0]                                                     # a vector that a third of all rows share
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_and_exact_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "FIT_ROWS", 700)
    data = vectors(1500)
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15),
           (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (None, [1.0] * 16), (9100, []), data[40]]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in data + bad], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = truth(data, 100, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = {i: np.array(v, float) for i, v in data}
    for q, rows in got.items():
        assert rows == sorted(rows)
        assert all(s == float(np.sqrt(((by_id[i] - by_id[q]) ** 2).sum())) for s, i in rows)
    assert got[0] == want[0]                                           # ties go to smaller ids


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert ann.search(df.limit(0)).count() == 0


def test_best_bins_visit_every_leaf_once_nearest_branch_first():
    rng = np.random.default_rng(3)
    x, leaves = rng.normal(size=(2000, 8)), []
    tree = ann.grow(x, rng, leaves)
    order = list(ann.best_bins(tree, x[5]))
    assert sorted(order) == leaves and order[0] == ann.assign(tree, x[5:6])[0]


def test_an_id_of_two_vectors_asks_with_the_smaller(spark):
    rows = [(100, [5.0, 1.0]), (100, [2.0, 9.0]), (1, [2.0, 8.0]), (2, [5.0, 2.0])]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(n)
        got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df).where("query_id = 100").orderBy("rank").collect()]
        assert got[0] == (1, 1, 1.0) and got[-1][1] == 2
