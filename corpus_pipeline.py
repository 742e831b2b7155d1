"""A training corpus from ``documents``: language ID, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, jaccard, langid, line_dedup, packing
from orrery.llm.common import SPACE_CHARS, Saved, nested, table, unnested


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language, or several; learns from their labels.

    Null, empty and letterless texts go.  Rows are judged one by one, so null and repeated ids change nothing; an
    empty table stays empty; no column's name can clash.
    """
    found = langid.identify(docs.select(nested(docs), "text"), langid.fit(docs), keep=("row", "text"))
    return found.where(F.col("lang_pred") != "und").select(*unnested(docs.columns, F.col("text")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in one of them; documents that lose all their text go.

    Texts that lose no line stay as they are, null and empty ones among them; n_chars follows the text.  A null doc_id
    is smaller than any other; rows repeated with one doc_id each count as a document.  An empty table stays empty; no
    column's name can clash.
    """
    out = line_dedup.dedup_lines(docs).where("n_dropped > 0").select("rid", F.col("doc_id").alias("x_id"), F.array_join("lines", "\n").alias("kept"))
    changed = Saved(spark, "line-stage").keep(out.dropDuplicates(["rid", "x_id"]).withColumnRenamed("rid", "x_rid"), "changed")
    own = docs.select(nested(docs), "text", F.col("doc_id").alias("own_id"), line_dedup.row_key().alias("rid"))
    joined = own.join(changed, (F.col("rid") == F.col("x_rid")) & F.col("own_id").eqNullSafe(F.col("x_id")), "left")
    joined = joined.where(F.col("kept").isNull() | (F.btrim("kept", F.lit(SPACE_CHARS)) != ""))
    lengths = {c: F.when(F.col("kept").isNull(), F.col("row")[c]).otherwise(F.char_length("kept").cast(docs.schema[c].dataType)) for c in docs.columns if c == "n_chars"}
    return joined.select(*unnested(docs.columns, F.coalesce("kept", "text"), **lengths))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id.  Five words, similarity 0.8.

    Null and empty texts link with nothing and stay, so do rows without an id.  Rows repeated with one doc_id are one
    document, they stay or go together.  An empty table stays empty; only doc_id and text are read of the columns.
    """
    groups = jaccard.near_duplicates(docs, width=5, num=80, den=100)
    lost = groups.where("doc_id != component_id").select(F.col("doc_id").alias("lost_id")).distinct()
    own = docs.select(nested(docs), "text", F.col("doc_id").alias("own_id"))
    return own.join(lost, F.col("own_id") == F.col("lost_id"), "left_anti").select(*unnested(docs.columns, F.col("text")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly are benchmark text go.  Odd rows: see ``decontaminate``."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens.  A null or empty text is its end token alone; each row is packed, whatever its id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier, the automaton nor the packing; tests/llm/test_catalog.py holds each stage and run()
#: against a plain version, on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    saved = Saved(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
