"""Removal of word windows that start in an earlier document.

A window is ``window`` consecutive words.  Its anchor (see ``windows``) is counted in
count-min sketches, one per partition, which are merged; a window that occurs twice has
an anchor that occurs twice, so no repeated window is estimated as single.  The second
pass takes only runs whose anchor is estimated repeated and settles them exactly:

1. per anchor: the smallest and largest document and whether all its runs are equal;
   an anchor of one document is dropped;
2. equal runs: all starts of a run are covered if an equal run lies in a smaller document;
3. where an anchor has unequal runs, the first of each kind gives its windows, and
   windows are grouped by 128-bit hashes to find the smallest document of each.

Counts and minima combine on the map side, so a passage that a third of all documents
share costs a row per task; no group is ever gathered.

Defined cases: a null or empty text has no words; texts are read whole; a null id counts
as larger than every other, and rows with equal ids never remove from each other;
an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hashing import covered, signed, window_hashes, word_bounds, word_hashes
from .inputs import map_frames
from .sketch import maybe_among, maybe_repeated, repeated_bits
from .windows import anchored_runs, starts_mask

RUNS = "anchor long, kind long, doc long, tag long, start int, n int"
#: stands for a missing id
LAST = 2**63 - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (id, or the largest number for null), tag (hash of the text) and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text")
    )


def _runs(text: str, window: int, gram: int):
    return anchored_runs(word_hashes(text.encode()), window, gram)


def repeated_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs whose anchor is estimated to occur twice or more."""

    def anchors(frame: pd.DataFrame) -> np.ndarray:
        return np.concatenate([_runs(t, window, gram)[0] for t in frame["text"]]) if len(frame) else np.zeros(0, np.uint64)

    bits = texts.sparkSession.sparkContext.broadcast(repeated_bits(texts.select("text"), anchors))  # 8 MB, fixed

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, tag, text in zip(frame["doc"], frame["tag"], frame["text"]):
            anchor, start, n, kind, _ = _runs(text, window, gram)
            if len(anchor):
                keep = maybe_repeated(anchor, bits.value)
                if keep.any():
                    out.append((np.full(keep.sum(), doc), np.full(keep.sum(), tag), anchor[keep], start[keep], n[keep], kind[keep]))
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in RUNS.split(", ")})
        doc, tag, anchor, start, n, kind = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"anchor": signed(anchor), "kind": signed(kind), "doc": doc, "tag": tag, "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return map_frames(texts, each, RUNS)


def window_rows(runs_of_docs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """Windows of the given runs: anchor, kind, doc, at (place in the run) and two hashes."""
    lists = runs_of_docs.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "kind", "start", "n")).alias("runs"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, text, found in zip(frame["doc"], frame["text"], frame["runs"]):
                words = word_hashes(text.encode())
                one, two = window_hashes(words, window, salt=3), window_hashes(words ^ np.uint64(0xA5A5A5A5A5A5A5A5), window, salt=4)
                start, n = np.array([r["start"] for r in found]), np.array([r["n"] for r in found])
                which = np.repeat(np.arange(len(found)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                place = start[which] + at
                yield pd.DataFrame(
                    {
                        "anchor": np.array([r["anchor"] for r in found])[which],
                        "kind": np.array([r["kind"] for r in found])[which],
                        "doc": doc,
                        "at": at.astype(np.int32),
                        "w1": signed(one[place]),
                        "w2": signed(two[place]),
                    }
                )

    # rows of equal id and text give their windows once; texts of no run aren't shuffled
    return texts.where(maybe_among(runs_of_docs)).join(lists, ["doc", "tag"]).mapInPandas(each, "anchor long, kind long, doc long, at int, w1 long, w2 long")


def covered_starts(docs: DataFrame, window: int, gram: int | None = None) -> DataFrame:
    """doc, tag and the starts (lists of start and number) of windows that also start in a smaller document."""
    gram = gram or window // 2
    texts = keyed(docs)
    found = cut_lineage(repeated_runs(texts, window, gram))
    per_anchor = (
        found.groupBy("anchor")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
        .where("low < high")
        .select("anchor", (F.col("k1") != F.col("k2")).alias("mixed"))
    )
    per_kind = found.groupBy("anchor", "kind").agg(F.min(F.struct("doc", "tag", "start", "n")).alias("first"))
    kinds = cut_lineage(per_kind.join(per_anchor, "anchor").select("anchor", "kind", "mixed", "first.*"))
    marked = found.join(kinds.select("anchor", "kind", "mixed", F.col("doc").alias("first_doc")), ["anchor", "kind"])
    later = marked.where("doc > first_doc").select("doc", "tag", "start", "n")
    # windows of unequal runs of one anchor
    shown = window_rows(kinds.where("mixed").select("anchor", "kind", "doc", "tag", "start", "n"), texts, window)
    smallest = shown.groupBy("w1", "w2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w1", "w2", "low")
    hit = shown.join(smallest, ["w1", "w2"]).where("doc > low").select("anchor", "kind", "doc", "at").distinct()
    places = hit.join(marked.where("mixed and doc = first_doc").select("anchor", "kind", "doc", "tag", "start"), ["anchor", "kind", "doc"])
    inner = places.select("doc", "tag", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return later.union(inner).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("starts"))


def removal_masks(docs: DataFrame, window: int) -> DataFrame:
    """doc, text and starts of every row (starts null where nothing is removed)."""
    return keyed(docs).join(covered_starts(docs, window), ["doc", "tag"], "left")


def removed_words(text: str, starts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of a text and the mask of the removed words."""
    a, b = word_bounds(text.encode())
    if starts is None or not len(starts):
        return a, b, np.zeros(len(a), bool)
    mask = starts_mask(np.array([s["start"] for s in starts]), np.array([s["n"] for s in starts]), len(a))
    return a, b, covered(np.flatnonzero(mask), window, len(a))


def kept_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by single spaces."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, starts in zip(frame["text"], frame["starts"]):
            data = text.encode()
            a, b, gone = removed_words(text, starts, window)
            if gone.any():
                keep = b" ".join([data[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist())])
            else:
                keep = b" ".join(data.split())
            rows.append((len(a), int(gone.sum()), keep.decode(), hashlib.sha256(keep).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])
        out.insert(0, "doc", frame["doc"].to_numpy())
        return out

    out = map_frames(removal_masks(docs, window).select("doc", "text", "starts"), each, "doc long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")
