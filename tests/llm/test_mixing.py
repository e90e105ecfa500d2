import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), share * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > most * sizes[s]}
        if not above:
            return out | {s: w[s] * level for s in free}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= above
    return out


def rows(seed=3, n=600):
    rnd = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", "Z", "é", "\U0001f600", "￮", None]
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 200])), "en", rnd.choice(names)) for i in range(n)] + [
        (900, None, "en", "nothing"), (901, "", None, "nothing"), (7, "again and again", "en", "hot"),
        (7, "again and again", "en", "hot"), (None, "no id here", "en", "a"), (902, "w " * 30_000, "en", "b")]


def test_targets_equal_resharing_and_takes_come_near(spark, corpus):
    data = rows()
    df = corpus(data).withColumnRenamed("n_chars", "target")            # a clashing extra column
    got = mixing.rates(df).collect()
    size = defaultdict(int)
    for _, t, _, s in data:
        size[s] += len((t or "").split())
    want, taken = water_fill(size), defaultdict(int)
    assert len(got) == len(data)
    by_id = {d: s for d, _, _, s in data}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r.copies <= 2
        taken[s] += r.copies * r.size
    for s in size:
        biggest = max(len((t or "").split()) for _, t, _, x in data if x == s)
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], biggest)
    assert sorted(map(str, got)) == sorted(map(str, mixing.rates(df.repartition(7)).collect()))


def test_mix_emits_the_copies(spark, corpus):
    data = rows(5, 200)
    df = corpus(data).withColumnRenamed("n_chars", "copies")
    times = Counter()
    for r in mixing.rates(df).collect():
        times[r.doc_id] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +times


def test_draws_are_uniform_per_column(spark):
    from pyspark.sql import functions as F
    d = spark.range(4000).select(mixing.draws(F.col("id")).alias("u")).toPandas().u
    import numpy as np
    x = np.array(d.tolist())
    assert x.shape == (4000, mixing.DRAWS) and ((x >= 0) & (x < 1)).all()
    assert (abs(x.mean(0) - 0.5) < 0.02).all() and (abs(np.corrcoef(x.T) - np.eye(x.shape[1])) < 0.07).all()


def test_empty_table(spark, corpus):
    assert mixing.rates(corpus([])).count() == 0 and mixing.mix(corpus([])).count() == 0
