import re

import corpus_pipeline
from tidemark.llm import mixing, packing, quality, secrets, simhash
from tests.llm.test_near_copies import groups
from tests.llm.test_quality import plain, rows as quality_rows, words
from tests.llm.test_simhash import brute, plain as plain_fingerprint


def test_stages_apply_their_operators_in_order(spark, corpus, tmp_path):
    import random
    rnd = random.Random(6)
    data = [(i, t, la, s) for i, t, la, s in quality_rows() if i is not None and i != 905]
    data += [(1000, data[50][1] + " end", "en", "hot"), (1001, data[51][1], "en", "b"),
             (1001, data[51][1], "en", "b"), (None, words(rnd, 30), "en", "b"),
             (1002, words(rnd, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "b")]
    corpus(data).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        if name != "best-fit packing":
            assert docs.columns == before.columns
        seen.append(docs.collect())
    good, one, masked, mixed, packed = seen
    failed = {d for d, t, *_ in data if plain(t)[5]}
    junk = {d for d, t, *_ in data if "%%%" in (t or "")}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")                  # noqa: E731
    assert sorted(((r.doc_id, r.text) for r in good), key=key) == sorted(
        ((d, t) for d, t, *_ in data if d not in failed | junk), key=key)
    ids, fps = [r.doc_id for r in good], [plain_fingerprint(r.text) for r in good]
    first = brute(ids, fps)
    survivors = {r.doc_id: r.text for r, f in zip(good, first) if r.doc_id is not None and r.doc_id == f}
    second = groups(sorted(survivors.items()))
    assert second[1000] == data[50][0] != 1000                              # a near copy
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted(
        d for d in survivors if second[d] == d)
    assert sum(r.doc_id is None for r in one) == 1 and len(masked) == len(one)
    assert {r.doc_id for r in masked if "[SECRET]" in r.text} == {1002}
    assert all(r.n_chars == len(r.text) for r in masked)
    copies = {r.doc_id: r.copies for r in mixing.rates(spark.createDataFrame(masked, docs_schema(spark, tmp_path))).collect()}
    assert len(mixed) == sum(copies.values())
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))            # noqa: E731
    assert sum(r.n_tokens for r in packed) == sum(tokens(r.text) for r in mixed)


def docs_schema(spark, tmp_path):
    return spark.read.parquet(f"{tmp_path}/documents.parquet").schema


def test_run_equals_the_stages_and_takes_an_empty_table(spark, corpus, tmp_path):
    corpus([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert {quality, secrets, simhash, packing}                             # imported operators
