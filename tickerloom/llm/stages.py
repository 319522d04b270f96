"""Operators as stages: documents in, documents with the same columns out.

Rows are carried whole in one struct, so extra columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import aligned_lines, count_tree, language, substrings
from .sketch import maybe_among


def _carried(docs: DataFrame) -> DataFrame:
    """doc, tag, text and the row itself."""
    # the three are computed from the struct's fields as ``keyed`` does it
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(substrings.LAST))
    return row.select(doc.alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"), "row")


def _with_text(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of the shape of ``like`` with ``new_text`` where it isn't null, and its length."""
    out = []
    for c in like.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            old = F.coalesce("new_text", old)
        elif c == "n_chars":
            old = F.coalesce(F.length("new_text").cast(like.schema[c].dataType), old)
        out.append(old.alias(c))
    return rows.select(*out)


def _rewritten(docs: DataFrame, marks: DataFrame, mark: str, rewrite) -> DataFrame:
    """Documents with the texts that ``rewrite(text, marks)`` gives; one that loses its last word goes.

    Only rows that may have marks are shuffled, each with one copy of its text.
    """
    marks = cut_lineage(marks)
    rows = _carried(docs).drop("text").withColumn("marked", maybe_among(marks))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def new_text(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if f is None or not len(f) else rewrite(t, f) for t, f in zip(text, found)], dtype=object)

    changed = rows.where("marked").join(marks, ["doc", "tag"], "left").select("row", new_text(text, mark).alias("new_text"))
    changed = changed.where(F.col("new_text").isNull() | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(rows.where("not marked").select("row", F.lit(None).cast("string").alias("new_text")).union(changed), docs)


def known_language(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents whose language is recognised; a missing label is filled with it."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = language.train(base.where(~language.held_out(F.col("doc_id"))))
    rows = language.predict(_carried(docs), model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= min_score))
    return rows.select(*[F.coalesce(F.col("row.lang"), "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_common_blocks(docs: DataFrame) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has."""
    return _rewritten(docs, aligned_lines.deleted_blocks(docs), "blocks", lambda t, b: aligned_lines.keep_lines(t, b)[0])


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    kept = count_tree.near_duplicates(docs, size, percent).where("keep").select("doc", "tag", "n_shingles").distinct()
    same = Window.partitionBy("doc", "tag").orderBy("n_shingles")
    rows = _carried(docs).join(kept, ["doc", "tag"]).withColumn("copy", F.row_number().over(same))
    return rows.where("copy = 1 or n_shingles = 0").select("row.*")


def without_repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Documents without the words of windows that start in an earlier document."""

    def rewrite(text: str, starts) -> str:
        data = text.encode()
        a, b, gone = substrings.removed_words(text, starts, window)
        out, at = [], 0
        edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        for first, end in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            out.append(data[at : a[first]])
            at = a[end] if end < len(a) else len(data)
        return b"".join([*out, data[at:]]).decode()

    return _rewritten(docs, substrings.covered_starts(docs, window), "starts", rewrite)


