"""A corpus pipeline over ``documents``: each stage is one operator of ``deducta.llm``.

Stages before the last take and return the columns of ``documents``; every decision is made on
all rows of its stage's input.

* Rows with a null doc_id or text pass through like any other; a null text counts as an empty one.
* Empty and null texts are not toxic, are copies of one another, hold no benchmark words and no personal data,
  and are packed as the end id alone.  Ties are decided by doc_id and then text.
* Very long texts cost the memory that the operators state.  Columns other than those of documents are dropped.
* An empty ``documents``, ``benchmark`` or ``labels`` gives an empty result, no hit, or no toxic document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deducta.llm import decontaminate, packing, pii, simhash, toxicity
from deducta.llm.common import bounded, checkpoint, staged, table, tokenizer_file

BROADCAST = 1_000_000  # ids, of some 16 bytes each, that are sent to every executor at most
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of each group of near copies, once.

    Near copies have a Jaccard similarity of five-word shingles of at least 0.8.  Different texts under one
    doc_id are different documents.  Of rows with equal doc_id and text, which differ in other columns, the
    smallest of those columns stay; a null text counts as the empty text.
    """
    rows = docs.select(*COLUMNS).withColumn("text_hash", simhash.text_hash())
    found = simhash.near_copies(docs).groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("id"), F.min("component_text").alias("hash"), F.count(F.lit(1)).alias("n"))
    found = checkpoint(found.select("doc_id", "text_hash", "n", (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).alias("first")).where("NOT first OR n > 1"))

    def of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        x, y = rows.alias("x"), keys.alias("y")
        return x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_hash") == F.col("y.text_hash")), how)

    lost, _ = bounded(found.where("NOT first").select("doc_id", "text_hash"), BROADCAST)
    kept = of(rows, lost, "left_anti")
    again, n = bounded(found.where("first").select("doc_id", "text_hash"), BROADCAST)
    if not n:
        return kept.select(*COLUMNS)
    other = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = of(kept, again, "left_semi").groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"), F.min(F.struct(*other)).alias("x"))
    return of(kept, again, "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", *(F.col(f"x.{c}") for c in other)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window hits; equal rows share a key and so a fate."""
    key = F.xxhash64("doc_id", "text")
    report = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit, _ = bounded(report.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), BROADCAST)
    return docs.select(*COLUMNS, key.alias("key")).join(hit, "key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed token windows."""
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_windows),
]

#: Fitted scores and token ids are not expressible in SQL; tests/llm compare the stages with slower versions of them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
