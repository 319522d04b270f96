"""One query for each operator: its result over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import aligned_lines, best_fit, count_tree, heap_counts, language, license_scan, prefix_trie, repetition, substrings, suffix_dedup, token_alignment, topk_search, transducer
from .inputs import set_batch_rows, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_batch_rows(spark)
    return table(spark, sf_dir, "documents")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir))


def op3_suffix_array_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.kept_bytes(documents(spark, sf_dir), width=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_words(documents(spark, sf_dir), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_lines.kept_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op7_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.component_rows(documents(spark, sf_dir), size=3, percent=90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    pieces = cut_lineage(best_fit.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2))
    return best_fit.pack(pieces, capacity=1024).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op8_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_transducer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    set_batch_rows(spark, 200)
    return token_alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_threshold_topk,
        op2_repetition_rules,
        op3_suffix_array_spans,
        op4_count_min_substrings,
        op5_aligned_lines,
        op6_best_fit_packing,
        op7_count_tree_join,
        op8_language_families,
        op9_transducer_round_trip,
        op10_heap_token_counts,
        op11_token_alignment,
        op12_license_scan,
        op13_prefix_trie,
    )
}
ORACLE_SQL: dict[str, str] = {"op12_license_scan": license_scan.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
