"""From raw documents to packed sequences: each stage works on all that the one before kept.

quality rules -> near duplicates -> repeated passages -> benchmark passages -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from sluice.llm.common import discard, stored
from sluice.llm.queries import table, tokenizer_path

#: Best-fit packing and expectation-maximisation are not expressed in SQL; tests/llm/test_pipeline.py holds each stage, and
#: run(), against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without text among them. Repeated rows are judged alike."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, of repeated rows one; documents without words, and without doc_id, all stay."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has go; a document of which nothing is left goes, too. Texts without
    such windows, nulls among them, stay as they are."""
    out = substring_dedup.remove_repeats(_marked(docs))
    touched = F.size("removed") > 0
    out = out.withColumn("text", F.when(touched, F.col("kept_text").cast("string")).otherwise(F.col("text")))
    return _columns(out.filter(~touched | (F.length("text") > 0)), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    found = decontaminate.find_windows(_marked(docs), table(spark, sf_dir, "benchmark"))
    return _columns(found.filter("size(items) = 0"), docs)


#: A column of our own beside those of documents: whether the text was null, which operators take for empty.
WAS_NULL = "_text_was_null"


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(WAS_NULL, F.col("text").isNull())


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again; n_chars follows the text."""
    text = F.when(~F.col(f"carried.{WAS_NULL}"), F.col("text"))
    found = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(found.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null text counts as empty."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; a result is deleted once the next is written,
    but for the one that packing reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if hasattr(before, "stored_at"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
