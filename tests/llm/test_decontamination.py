import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination
from tidemark.llm.decontamination import WINDOW, Automaton

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """Every window of every item looked up at every place of every document."""
    wins = {}
    for name, text in items:
        ws = split(text)
        for k in range(max(len(ws) - WINDOW, 0) + 1 if ws else 0):
            wins.setdefault(tuple(ws[k:k + WINDOW]), set()).add(name)
    out = []
    for doc_id, text in docs:
        ws, hit, names = split(text), set(), set()
        for m in {len(w) for w in wins}:
            for k in range(len(ws) - m + 1):
                if (own := wins.get(tuple(ws[k:k + m]))) is not None:
                    hit.update(range(k, k + m))
                    names |= {str(n) for n in own if n is not None}
        out.append((doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, extra=""):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontamination.report(d, i).collect()), key=str)


def random_tables(seed, letters="abc"):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, line(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]) if k % 7 else 4)) for k in range(40)]
    items += [(100 + k, items[3][1]) for k in range(15)] + [(3, line(12)), (None, line(13)), (60, None), (61, ""), (62, "?! --")]
    docs = [(k, line(rng.randrange(60))) for k in range(60)]
    docs += [(k, f"{line(5)} {rng.choice(items[:40])[1]}, {line(4)}") for k in range(60, 100)]
    docs += [(None, line(40)), (None, None), (5, ""), (5, docs[5][1]), (7, items[6][1].upper())]
    return docs, items


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcd"), (3, ["Wé", "straße", "X1", "漢字", "b", "c"])])
def test_report_against_brute_force(spark, seed, letters):
    docs, items = random_tables(seed, letters)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = random_tables(9, "abcde")
    items.append((500, " ".join(random.Random(4).choice("abcde") for _ in range(200))))
    docs.append((800, "x " + items[-1][1][60:300] + " y"))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 120)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 23)
    monkeypatch.setattr(decontamination, "BLOCKS_A_PASS", 2)
    assert run(spark, docs, items) == brute(docs, items)


def test_automaton_is_small_and_knows_every_substring():
    rng = random.Random(6)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    a = Automaton().build([(str(k), t, True) for k, t in enumerate(texts)])
    total = sum(map(len, texts))
    assert len(a.link) <= 2 * total and len(a.step) <= 3 * total + 1
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(2000):
        probe = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))]
        v = 0
        for w in probe:
            v = None if v is None else a.step.get(v * a.size + a.vocabulary[w])
        assert (v is not None) == (tuple(probe) in known)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "some words"), (2, None)], []) == brute([(1, "some words"), (2, None)], [])
    assert run(spark, [(1, "some words")], [(1, None), (2, "...")]) == brute([(1, "some words")], [])


def test_spans_are_cut_and_the_rest_stays(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Before, it. {item}!  After — ß", "k", 9), (2, "nothing here", "k", 9), (3, None, "k", 9),
            (4, "é one, TWO (three) four five-six seven. eight nine ten end", "k", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, hits string, extra int")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = {r["doc_id"]: r for r in decontamination.decontaminate(d, i).collect()}
    assert {k: r["text"] for k, r in cut.items()} == {1: "Before, it. !  After — ß", 2: "nothing here", 3: None, 4: "é  end"}
    assert cut[1]["extra"] == 9 and [tuple(h) for h in cut[1]["hits"]] == [(2, 14, 12)]
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, i, longest=11, coverage=0.9).collect()}
    assert kept[1] == "Before, it. !  After — ß" and kept[4] == docs[3][1]
    covered = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, i, longest=11, coverage=0.5).collect()}
    assert covered[4] == "é  end"
