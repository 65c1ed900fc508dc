"""Documents to training tokens: the stages in order, each a function of the documents before it.

A stage takes ``(spark, docs, sf_dir)`` and works on all of ``docs``; all but the last return the columns
of documents. Documents are told apart by doc_id: rows that share one stay or go together, and rows
with a null doc_id pass the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegraph.llm import op2_bpe, op3_language_id, op4_line_dedup, op6_decontaminate, op8_minhash_dedup
from lakegraph.llm.shared import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unknown or ambiguous language go; a null or empty text is of unknown language.

    Without rows to learn from every language is unknown. An empty table stays empty.
    """
    return op3_language_id.keep_identified(docs, op3_language_id.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars``, where there is one, follows the text."""
    kept = op4_line_dedup.drop_shared_lines(docs, counts=("_lines", "_dropped_lines"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return op8_minhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go; null and empty texts contain none and stay.

    Items without text, and an empty benchmark, remove nothing. Only the columns of ``docs`` are returned,
    whatever the benchmark's are called.
    """
    return op6_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of ids and decoded bytes; a null text has no ids.

    ``doc_id, ids`` and the digests are returned, other columns are not.
    """
    return op2_bpe.digests(op2_bpe.tokenised(docs), "ids")


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe_tokens", tokens),
]

# Trained models and byte-pair merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
