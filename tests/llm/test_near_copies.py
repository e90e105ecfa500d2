import random

import pytest

from tests.llm.test_simhash import brute, plain
from tidemark.llm import simhash


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, similarity=0.8):
    """Smallest id of the component over exact similarities, all pairs compared."""
    sets = [(d, shingles(t)) for d, t in rows]
    comp = {d: d for d, _ in rows}
    changed = True
    links = [(d, e) for d, x in sets for e, y in sets
             if d < e and x and y and len(x & y) >= similarity * len(x | y)]
    while changed:
        changed = False
        for d, e in links:
            low = min(comp[d], comp[e])
            changed |= comp[d] != low or comp[e] != low
            comp[d] = comp[e] = low
    return comp


def families(seed, n=40):
    rnd = random.Random(seed)
    text = lambda k: [f"w{rnd.randrange(4000)}" for _ in range(k)]         # noqa: E731
    out = []
    for _ in range(n):
        base = text(rnd.choice([7, 30, 60, 90, 400]))
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(max(1, len(copy) // rnd.choice([30, 60, 90]))):
                at = rnd.randrange(len(copy))
                rnd.choice([lambda: copy.insert(at, "new"), lambda: copy.pop(at),
                            lambda: copy.__setitem__(at, "other")])()
            out.append(" ".join(copy))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_near_copies_are_the_exact_components(spark, corpus):
    rows = families(1)
    docs = corpus(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, docs.select("doc_id")).collect()}
    want = groups(rows)
    assert {d: got.get(d, d) for d, _ in rows} == want
    assert len(set(want.values())) <= len(rows) - 20                     # the fixture has links


def test_a_chain_of_edits_is_one_component(spark, corpus):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(4000)}" for _ in range(60)]
    rows = []
    for i in range(12):                                  # far ends share nothing
        rows.append((i, " ".join(words)))
        words[2 * i] = f"x{i}"
    rnd.shuffle(rows)
    want = groups(rows)
    assert set(want.values()) == {0}
    docs = corpus(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, docs.select("doc_id")).collect()}
    assert got == want


def test_a_band_shared_by_unlike_texts_is_met_whole(spark, corpus, monkeypatch):
    """Keys that all share, so each round's questions decide alone."""
    monkeypatch.setattr(simhash, "band_keys", lambda *_: [1])
    rows = families(5, 6)
    docs = corpus(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, docs.select("doc_id")).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == groups(rows)


def test_keep_first_keeps_one_of_each_group(spark, corpus):
    rows = families(7, 25)
    rows += [(900, None), (901, ""), (902, " "), (903, rows[0][1]), (904, "short"), (904, "short")]
    kept = [r.doc_id for r in simhash.keep_first(corpus([*rows, (None, rows[1][1])])).collect()]
    unique = dict(rows)
    ids = sorted(unique)
    first = dict(zip(ids, brute(ids, [plain(unique[i]) for i in ids])))
    second = groups([(d, unique[d]) for d in ids if first[d] == d])
    assert sorted(k for k in kept if k is not None) == [d for d in ids if second.get(d) == d]
    assert kept.count(None) == 1


def test_two_texts_of_one_id_stay_out_of_near_copies(spark, corpus):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " end"), (2, b)]
    assert sorted(r.text for r in simhash.keep_first(corpus(rows)).collect()) == sorted(t for _, t in rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "one two three four five six")]])
def test_nothing_to_link(spark, corpus, rows):
    assert simhash.keep_first(corpus(rows)).count() == len(rows)


def test_a_star_of_copies_is_not_met_pair_by_pair(spark, corpus, monkeypatch):
    """Copies of one text that are unlike each other but for some, in one group of several blocks."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(146)]
    rows = []
    for d in range(90):
        copy = list(base)
        for at in rnd.sample(range(5, 140, 8), 4):
            copy[at] = f"c{d}x{at}"
        rows.append((d, " ".join(copy)))
        if d % 9 == 0:
            rows.append((500 - d, " ".join([*copy[:70], "new", *copy[71:]])))
    want = groups(rows)
    assert 80 < len(set(want.values())) <= 90
    met, kept = [], simhash.verified
    monkeypatch.setattr(simhash, "band_keys", lambda *_: [1])
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a: met.append(pairs.count()) or kept(pairs, *a))
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 4000, raising=False)
    docs = corpus(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, docs.select("doc_id")).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == want
    assert sum(met) <= 9 * len(rows)
