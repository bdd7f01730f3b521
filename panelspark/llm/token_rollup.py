"""Token counts as rollups that signed deltas maintain.

The state is a folder of batches and a commit log; a batch holds additive totals by source, language and
tokenizer version: documents and tokens that were inserted (positive), deleted (negative) or recounted
(the difference). A batch is written to a folder of its own and counts from the moment its one-row log entry
stands; the latest entry of a batch id holds, so a delivery counts once however often it comes, and a
delivery that broke off counts nothing. ``compact`` writes the totals so far as one snapshot; from then on only later
batches are read, and a batch that is delivered anew after it was counted there is first subtracted.

Deltas are signed changes between two tables of per-document counts; they need the counts, never the
texts. Null sources and languages are groups of their own; null texts have no tokens; a document id that
repeats within one table counts with every row; rows without an id are matched by what else they hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import common  # noqa: F401
from panelspark.llm.vector_packing import VOCABULARY, encoder, tokenizer_files
from panelspark.session import shared_dir, stage_table

GROUP = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "inserted", "deleted", "revised"]
#: A commit (``covers`` null) or a snapshot with the folders it holds.
LOG_SCHEMA = "seq long, batch string, folder string, covers array<struct<batch:string,folder:string>>"
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, inserted long, deleted long, revised long"


def _count(json_path: str, ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return run


def counts(docs: DataFrame, tokenizers_folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, text_key, tokenizer, n_tokens of every row."""
    text = docs[text_col].cast("string")
    some = docs.select(docs[id_col].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.xxhash64(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), text.alias("_text"))
    out = some.mapInArrow(_count(*tokenizer_files(tokenizers_folder)), "doc_id long, source string, lang string, text_key long, n_tokens long")
    return out.withColumn("tokenizer", F.lit(VOCABULARY))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes per group between two tables of counts: new, gone and recounted documents."""
    key = [*GROUP, "doc_id"]
    old = before.select(*key, F.lit(-1).alias("sign"), "n_tokens")
    both = old.unionByName(after.select(*key, F.lit(1).alias("sign"), "n_tokens"))
    per_doc = both.groupBy(*key).agg(
        F.sum("sign").cast("long").alias("d"), F.sum(F.col("sign") * F.col("n_tokens")).alias("t"), F.count(F.when(F.col("sign") > 0, 1)).alias("now"),
        F.count(F.when(F.col("sign") < 0, 1)).alias("was"),
    )
    recount = (F.col("d") == 0) & (F.col("t") != 0)
    return per_doc.groupBy(*GROUP).agg(
        F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"), F.sum(F.greatest("d", F.lit(0))).alias("inserted"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("deleted"),
        F.sum(F.when(recount, F.col("now")).otherwise(0)).alias("revised"),
    ).filter("n_docs != 0 OR n_tokens != 0 OR inserted != 0 OR deleted != 0 OR revised != 0")


def _summed(changes: DataFrame, *more: str) -> DataFrame:
    return changes.groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in [*TOTALS, *more]])


class Rollup:
    """Totals by source, language and tokenizer version in a folder of batches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"

    def log(self) -> list[Row]:
        """All entries in order: one per commit and snapshot."""
        try:
            found = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log").collect()
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(found, key=lambda r: (r.seq, r.folder))

    def _enter(self, batch: str | None, folder: str, covers: list[tuple[str, str]] | None) -> None:
        """One file, which the committer moves into the log whole."""
        seq = max((r.seq for r in self.log()), default=0) + 1
        self.spark.createDataFrame([(seq, batch, folder, covers)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Stores a batch of deltas; committing the same id again replaces it, whatever came of the first try."""
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id consists of letters, digits, - and _")
        folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
        _summed(changes).withColumn("n_batches", F.lit(1).cast("long")).write.parquet(f"{self.path}/{folder}")
        self._enter(batch_id, folder, None)

    def _terms(self) -> tuple[dict[str, int], dict[str, str]]:
        """Folders that make up the totals with their signs, and the folder that holds for each batch."""
        signs: dict[str, int] = {}
        held: dict[str, str] = {}
        base: Row | None = None
        for r in self.log():
            if r.covers is None:
                held[r.batch] = r.folder
            else:
                base = r
        within = {c.batch: c.folder for c in base.covers} if base else {}
        if base:
            signs[base.folder] = 1
        for batch, folder in held.items():
            if within.get(batch) != folder:
                signs[folder] = 1
                if batch in within:
                    signs[within[batch]] = -1
        return signs, held

    def totals(self) -> DataFrame:
        """The additive totals over all committed batches; groups whose documents are all gone stay with zeros
        while a batch names them."""
        return self._totals(self._terms()[0])

    def _totals(self, signs: dict[str, int]) -> DataFrame:
        schema = f"{DELTA_SCHEMA}, n_batches long"
        out = self.spark.createDataFrame([], schema)
        for sign in (1, -1):
            folders = [f"{self.path}/{f}" for f, s in signs.items() if s == sign]
            if folders:
                rows = self.spark.read.schema(schema).parquet(*folders)
                out = out.unionByName(rows.withColumns({c: F.col(c) * sign for c in [*TOTALS, "n_batches"]}))
        return _summed(out, "n_batches").filter("n_batches > 0")

    def compact(self) -> None:
        """Writes the totals as a snapshot that stands for all batches committed so far."""
        signs, held = self._terms()
        folder = f"snapshot-{uuid.uuid4().hex}"
        self._totals(signs).write.parquet(f"{self.path}/{folder}")
        self._enter(None, folder, sorted(held.items()))


def without_copies(counted: DataFrame) -> DataFrame:
    """Counts without rows whose text an earlier document has: per text the rows of the smallest id stay."""
    first = counted.groupBy("text_key").agg(F.min("doc_id").alias("_first"))
    return counted.join(first, "text_key").filter("doc_id <=> _first").drop("_first")


def maintained(docs: DataFrame, state: str | None = None) -> DataFrame:
    """Three deliveries over a whole table: all documents are inserted; then exact copies leave and the
    others are recounted with their closing token; then, after a snapshot, the second delivery arrives again."""
    rollup = Rollup(docs.sparkSession, state)
    counted = stage_table(counts(docs), "counts")
    rollup.commit("1-load", deltas(counted.limit(0), counted))
    kept = without_copies(counted).withColumn("n_tokens", F.col("n_tokens") + 1)
    change = stage_table(deltas(counted, kept), "change")
    rollup.commit("2-clean", change)
    rollup.compact()
    rollup.commit("2-clean", change)
    return rollup.totals()
