import random

from tidemark.llm import rollups

SCHEMA = "op string, seq int, doc_id long, source string, lang string, tokenizer string, tokens long, sign int"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def replay(state, rows):
    """The same batch on a plain dict."""
    last = {}
    low = lambda v: (v is not None, v if v is not None else 0)                          # noqa: E731
    for op, seq, d, s, la, t, n, _ in rows:
        key = (seq, op, n or 0, (s is not None, s or ""), (la is not None, la or ""))
        if (d, t) not in last or key > last[d, t][0]:
            last[d, t] = (key, op, s, la, n or 0)
    for e, (_, op, s, la, n) in last.items():
        state.pop(e, None)
        if op != "delete":
            state[e] = (s, la, n)
    out = {}
    for (_, t), (s, la, n) in state.items():
        docs, tokens = out.get((s, la, t), (0, 0))
        out[s, la, t] = (docs + 1, tokens + n)
    assert low
    return out


def batch(rnd, n):
    return [(rnd.choice(["insert", "insert", "revise", "delete"]), rnd.randrange(3), rnd.choice([None, *range(40)]),
             rnd.choice(["hot", "hot", "a", None]), rnd.choice(["en", None]), rnd.choice(["v1", "v2"]),
             rnd.choice([None, 0, 5, 123]), 7) for _ in range(n)]


def test_deltas_equal_a_full_recount_and_commits_are_idempotent(spark, tmp_path):
    rnd = random.Random(4)
    store, state = rollups.Rollup(spark, str(tmp_path / "r")), {}
    assert totals(store) == {}
    for k in range(3):
        rows = batch(rnd, 60)
        rows += rows[:5]                                                                # repeated rows
        df = spark.createDataFrame(rows, SCHEMA)
        want = replay(state, rows)
        assert store.commit(f"b{k}", df) and totals(store) == want
        assert not store.commit(f"b{k}", spark.createDataFrame(batch(rnd, 20), SCHEMA)) and totals(store) == want
    assert store.commit("none", spark.createDataFrame([], SCHEMA)) and totals(store) == want


def test_a_broken_batch_is_not_read_and_is_done_anew(spark, tmp_path):
    root = str(tmp_path / "r")
    store = rollups.Rollup(spark, root)
    one = spark.createDataFrame([("insert", 0, 1, "s", "en", "v", 10, 0)], SCHEMA)
    store.commit("a", one)
    left = spark.createDataFrame([(2, "v", "s", "en", 1, 99)], rollups.ENTRIES)
    left.write.parquet(f"{root}/entries/batch=b")                                       # no commit row
    left.selectExpr("source", "lang", "tokenizer", "1L AS n_docs", "99L AS n_tokens").write.parquet(f"{root}/deltas/batch=b")
    assert totals(store) == {("s", "en", "v"): (1, 10)}
    store.commit("b", spark.createDataFrame([("revise", 0, 1, "s", "en", "v", 4, 0)], SCHEMA))
    assert totals(store) == {("s", "en", "v"): (1, 4)} and store.batches() == ["a", "b"]


def test_counts_of_edge_texts(spark, corpus):
    got = {r.doc_id: (r.words, r.words_once, r.pieces) for r in rollups.counts(
        corpus([(1, None), (2, ""), (3, "a b1\na b1\nc!"), (4, "x " * 50_000)])).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (5, 3, 8), 4: (50_000, 50_000, 50_000)}
