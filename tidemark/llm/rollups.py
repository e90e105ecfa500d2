"""Delta-maintained token rollups.

Totals of documents and tokens by source, language and tokenizer version follow
batches of changes: inserts, deletes and revised counts. A batch becomes signed
rows, what each document's entry loses and gains, and their sums are its delta;
totals are the sums of deltas, so a batch costs work in its own size and in the
entries it touches.

The store is a folder of Parquet tables, one partition per batch, in ``entries``
(signed rows) and ``deltas`` (sums). A batch counts once its row stands in
``commits``, the last thing written, as one file. Committing a batch again changes
nothing; a batch that broke off is overwritten by its next try and is not read
before. Readers take the committed batches only.

Within a batch the last change of an entry (document and tokenizer, by ``seq``) is
the one that holds. Inserting a present entry revises it, revising an absent one
inserts it, and deleting an absent one does nothing.

Edge cases: null sources, languages and ids are values of their own; a null count
is 0; rows equal in all columns count once; rows of one entry and seq that differ
are resolved by the largest (operation, count, source, language); an empty batch
commits and changes nothing; columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count

ENTRY = ["doc_id", "tokenizer"]
KEYS = ["source", "lang", "tokenizer"]
ENTRIES = "doc_id long, tokenizer string, source string, lang string, sign int, tokens long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
INSERT, REVISE, DELETE = "insert", "revise", "delete"


class Rollup:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.root}/commits/batch={batch}/_SUCCESS")

    def batches(self) -> list[str]:
        """Names of committed batches: one per commit, never per row."""
        if not self._exists(f"{self.root}/commits"):
            return []
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = [f.getPath().getName().removeprefix("batch=") for f in found]
        return sorted(n for n in names if self.committed(n))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def entries(self) -> DataFrame:
        """(doc_id, tokenizer, source, lang, tokens) as they stand: signed rows whose
        signs do not cancel. Ids spread evenly, so no entry is hot."""
        return (self._read("entries", ENTRIES).groupBy(*ENTRY, "source", "lang", "tokens")
                .agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); empty groups are left out."""
        return (self._read("deltas", DELTAS).groupBy(*KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, seq, doc_id, source, lang, tokenizer, tokens); False
        if the batch was committed before."""
        if self.committed(batch):
            return False
        last = Window.partitionBy(*ENTRY).orderBy(F.desc("seq"), F.desc("op"), F.desc("tokens"),
                                                  F.desc("source"), F.desc("lang"))
        new = (changes.select("op", "seq", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
                              "tokenizer", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
               .withColumn("_turn", F.row_number().over(last)).where("_turn = 1"))
        old = self.entries().select(*[F.col(c).alias(f"old_{c}") for c in (*ENTRY, "source", "lang", "tokens")])
        same = F.lit(True)
        for c in ENTRY:
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
        met = new.join(old.withColumn("had", F.lit(True)), same, "left")

        def side(sign: int, prefix: str) -> Column:
            return F.struct(*[F.col(c if c in ENTRY else prefix + c).alias(c) for c in
                              ("doc_id", "tokenizer", "source", "lang")],
                            F.lit(sign).alias("sign"), F.col(prefix + "tokens").alias("tokens"))
        signed = met.select(F.explode(F.array_compact(F.array(
            F.when(F.col("had"), side(-1, "old_")),
            F.when(F.col("op") != DELETE, side(1, ""))))).alias("r")).select("r.*")
        target = f"{self.root}/entries/batch={batch}"
        signed.write.mode("overwrite").parquet(target)
        written = self.spark.read.schema(ENTRIES).parquet(target)
        (written.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"),
                                    F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
         .write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}"))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")
        return True


#: Letters, digits and other marks, split as simple pre-tokenizers do.
PIECES = r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+"


def counts(docs: DataFrame) -> DataFrame:
    """Words and pieces of every document, whole and without its repeated lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    once = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    pieces = lambda t: F.size(F.regexp_extract_all(t, F.lit(PIECES), F.lit(0))).cast("long")
    return docs.select("doc_id", "source", "lang", F.md5(text.cast("binary")).alias("digest"),
                       word_count(text).alias("words"), word_count(once).alias("words_once"),
                       pieces(text).alias("pieces"), pieces(once).alias("pieces_once"))


def as_changes(rows: DataFrame, op: str, seq: int, words: str, pieces: str) -> DataFrame:
    """A change per row and tokenizer version."""
    per = F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col(words).alias("tokens")),
                  F.struct(F.lit("pieces-1").alias("tokenizer"), F.col(pieces).alias("tokens")))
    return rows.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang",
                       F.explode(per).alias("t")).select("*", "t.*").drop("t")
