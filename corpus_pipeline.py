"""From raw documents to packed training sequences.

Each stage reads the documents that the one before it kept, as a written table:
language, aligned lines, near duplicates, repeated passages, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import stages
from tickerloom.llm.inputs import set_batch_rows, table
from tickerloom.llm.queries import packed
from tickerloom.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language."""
    set_batch_rows(spark)
    return stages.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks they share with an earlier one."""
    set_batch_rows(spark)
    return stages.without_common_blocks(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 0.8 or more of its five-word shingles."""
    set_batch_rows(spark)
    return stages.without_near_duplicates(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows of an earlier one."""
    set_batch_rows(spark)
    return stages.without_repeated_windows(docs, window=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    set_batch_rows(spark)
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]

#: SQL can't express the stages; tests compare lines, near duplicates and windows with plain Python, not language and packed ids
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
