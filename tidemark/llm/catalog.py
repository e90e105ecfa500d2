"""Registered corpus queries: thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (ann, decontamination, extraction, mixing, packing, passages, quality, rollups, secrets,
                          simhash, tries, warc, whitening)
from tidemark.llm.common import attach, durable, scratch, table
from tidemark.llm.registry import ORACLES, QUERIES, query  # noqa: F401

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP6_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
        CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * CAST(1.5 AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min_by(level, place) AS level FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target
        FROM l LEFT JOIN f ON true),
r AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM t),
d AS (SELECT doc_id, source, size, k, CAST(('0x' || substr(md5('mix:' || (k // 4) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')),
        CAST(8 * (k % 4) + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM sized, range(16) AS g(k)),
x AS (SELECT d.source, k, sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) AS added
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source GROUP BY d.source, k),
b AS (SELECT x.source, min_by(k, (abs(added - (target - floor(rate) * source_size)), k)) AS k
        FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source GROUP BY x.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


@query("op6_mix_sources", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix: weights 3, 1, 2 by source, 150 % of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.rates(docs).select("doc_id", "size", "source_size", "target",
                                     (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_simhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query("op5_quality_outliers")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and robust-outlier verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "distance")


@query("op8_secret_spans")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: base patterns and the fitted chain."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_crf",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words from all documents; none holds a source or text twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return packing.pack(packing.as_items(docs))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


@query("op4_warc_members", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a monolithic archive, its normalised members and back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch(spark, "warc"))


@query("op10_nearest_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op7_repeated_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of some 50 words or more that recur in other documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
f AS (SELECT md5(text) AS digest, min(doc_id) AS first_id FROM d GROUP BY 1),
k AS (SELECT d.source, d.lang, array_to_string(list_distinct(string_split(text, chr(10))), chr(10)) AS once
      FROM d JOIN f ON md5(d.text) = f.digest AND d.doc_id = f.first_id)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(once, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens FROM k GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*),
       CAST(sum(len(regexp_extract_all(once, '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+'))) AS BIGINT) FROM k GROUP BY ALL
"""


@query("op2_token_rollups", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches: all documents come in, their counts are
    revised to leave repeated lines out, and copies of a text with a smaller id are
    deleted. The last two are sent twice, which changes nothing."""
    store = rollups.Rollup(spark, scratch(spark, "rollup"))
    rows = durable(rollups.counts(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))
    first = durable(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    copies = attach(rows, first, ["digest"], "inner").where("doc_id <> first_id")
    changed = rows.where("words <> words_once OR pieces <> pieces_once")
    revised = rollups.as_changes(changed, rollups.REVISE, 1, "words_once", "pieces_once")
    gone = rollups.as_changes(copies, rollups.DELETE, 1, "words", "pieces")
    store.commit("1-load", rollups.as_changes(rows, rollups.INSERT, 1, "words", "pieces"))
    for name, changes in [("2-revise", revised), ("2-revise", revised), ("3-copies", gone), ("3-copies", gone)]:
        store.commit(name, changes)
    return store.totals()


@query("op11_whitened_vectors")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


OP13_SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS window, least(len(w), 10) AS m
      FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT r, m, k, array_to_string(w[k + 1 : k + m], ' ') AS window
      FROM (SELECT r, w, m, unnest(range(len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM v) WHERE len(w) >= m)),
o AS (SELECT DISTINCT r, p.m, k, item FROM p JOIN v ON p.window = v.window AND p.m = v.m),
h AS (SELECT r, count(DISTINCT t) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS t FROM o) GROUP BY r),
n AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


@query("op13_benchmark_spans", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, max(pos) AS own FROM t GROUP BY c),
k AS (SELECT c, own, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce(
            list_prepend(xor(s, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1
              THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 9 AS h FROM o),
m AS (SELECT k.c, base, h, least(h, coalesce(b.own, 0)) AS m FROM k LEFT JOIN o b ON b.c = k.base),
r AS (SELECT m.c, t.pos AS d, role, txt FROM m JOIN t ON t.c = m.base AND t.pos <= m.h
      UNION ALL SELECT t.c, t.pos - h + m, role, txt FROM t JOIN m ON t.c = m.c WHERE t.pos > h),
p AS (SELECT c, d, txt, md5(to_json(list({'r': role, 't': txt}) OVER (PARTITION BY c ORDER BY d))::VARCHAR) AS key FROM r),
q AS (SELECT c, d, key, strlen(txt) AS bytes, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p
      UNION ALL SELECT c, 0, '', 0, NULL FROM m),
n AS (SELECT key, any_value(up) AS up, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved
      FROM q GROUP BY key, d),
g AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g ON n.key = g.up),
s AS (SELECT q.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM l JOIN q ON q.c = l.conv_id AND q.d <= l.depth GROUP BY q.key),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM q GROUP BY c) GROUP BY key)
SELECT l.conv_id, depth, u.conv_id AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM l JOIN s USING (key) LEFT JOIN (SELECT key, conv_id FROM n) u ON u.key = l.up LEFT JOIN e ON e.key = l.key
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations."""
    return tries.trie(table(spark, sf_dir, "conversations"))
