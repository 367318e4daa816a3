"""The corpus pipeline: quality classifier, line dedup, near-dedup, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, lines, minhash, mixing, quality
from quantloom.llm.common import read_table, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents that score less are rejected.
MIN_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, fitted on the labelled rows that may be learned from, holds for junk."""
    return quality.keep_quality(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), MIN_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, however short; documents of which nothing is left go."""
    return lines.without_repeated_lines(docs, min_words=lines.ANY_RUN)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs, read_table(spark, sf_dir, "labels"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing_sources", mixing_stage),
    ("bpe_encoding", bpe_stage),
]

#: The classifier and the encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"pipeline-{name}")
    return docs
