"""Removal of aligned common blocks of lines from the later of two documents.

Runs of lines that occur in several documents are found by their hashes (a count-min
sketch drops the others).  From every line a run goes on, and to every line one comes,
until it holds ``min_chars`` bytes; the two kinds cover every line of a block of so many
bytes, wherever the block begins and ends.  Each document is paired with the earliest
holder of every run it shares, however many documents hold it.  A run gives each
document one partner at most, and so pairs never grow with the square of a group.
Blank lines aren't counted in runs; where some hold bytes (spaces, a carriage return)
that could make a block long enough, all shorter runs are taken as well.
Partners are aligned by patience diff (equal ends, then lines unique in both in their
longest common order, then the gaps), and runs aligned in both are deleted from the
later document if they hold at least ``min_chars`` bytes.

Defined cases: a null or empty text has no line and loses nothing; blank lines start no
block, and go with the block around them; texts are read whole; a null id counts as the
largest; rows with equal ids don't delete from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hashing import IS_SPACE, U64, byte_values, prefix_sums, signed, span_hashes
from .inputs import map_frames
from .sketch import maybe_repeated, repeated_bits
from .substrings import LAST, keyed

MIN_CHARS = 100


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash (0 for a blank line) and bytes of every line."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    ends = np.r_[np.flatnonzero(raw == 10), len(raw)]
    starts = np.r_[0, ends[:-1] + 1]
    hashes = span_hashes(prefix_sums(byte_values(data)), starts, ends, salt=6)
    ink = np.r_[0, np.cumsum(~IS_SPACE[raw])]
    hashes[ink[ends] == ink[starts]] = 0
    return hashes, ends - starts


def run_hashes(lines: np.ndarray, sizes: np.ndarray, min_chars: int, shorter: bool = False) -> np.ndarray:
    """Distinct hashes of the least runs of enough bytes from and to every line that isn't blank, and of all shorter ones."""
    inked = np.flatnonzero(lines)
    n = len(inked)
    if not n:
        return np.zeros(0, U64)
    min_chars = max(min_chars, 1)
    held = np.r_[0, np.cumsum(sizes[inked].astype(np.int64))]
    first, last = np.arange(n), np.searchsorted(held, held[:-1] + min_chars)
    ends = np.arange(1, n + 1)
    begin = np.searchsorted(held, held[1:] - min_chars, "right") - 1
    whole = last <= n
    starts, stops = [first[whole], begin[begin >= 0]], [last[whole], ends[begin >= 0]]
    if shorter:
        count = np.minimum(last - 1, n) - first
        starts.append(first.repeat(count))
        stops.append(starts[-1] + 1 + np.arange(count.sum()) - (np.cumsum(count) - count).repeat(count))
    return np.unique(span_hashes(prefix_sums(lines[inked].view(U64)), np.concatenate(starts), np.concatenate(stops), salt=7))


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Most pairs whose second parts rise; the first parts do already."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p : p + 1] = [j]
        at[p : p + 1] = [k]
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists by patience diff, in order."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        here, there = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if there[x] == 1}
        unique = [(k, place[x]) for k, x in enumerate(a[i:m], i) if x in place and here[x] == 1]
        p, q = i, j
        for x, y in longest_rising(unique):
            out.append((x, y))
            todo.append((p, x, q, y))
            p, q = x + 1, y + 1
        if (p, q) != (i, j):
            todo.append((p, m, q, n))
    return sorted(out)


def common_blocks(later: np.ndarray, sizes: np.ndarray, earlier: np.ndarray, min_chars: int) -> list[tuple[int, int]]:
    """Runs of lines of the later document aligned side by side in both, with enough bytes."""
    # blank lines are left out of the alignment
    a, b = np.flatnonzero(later), np.flatnonzero(earlier)
    pairs = align(later[a].tolist(), earlier[b].tolist())
    blocks, begin = [], 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] != pairs[k - 1][0] + 1 or pairs[k][1] != pairs[k - 1][1] + 1:
            first, last = a[pairs[begin][0]], a[pairs[k - 1][0]] + 1
            if sizes[first:last].sum() >= min_chars:
                blocks.append((int(first), int(last)))
            begin = k
    return blocks


def deleted_blocks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, tag and blocks (lists of first line and end) to delete."""

    def lines(frame: pd.DataFrame) -> pd.DataFrame:
        found = [line_hashes(t) for t in frame["text"]]
        return pd.DataFrame(
            {
                "doc": frame["doc"],
                "tag": frame["tag"],
                "lines": [signed(h) for h, _ in found],
                "sizes": [s for _, s in found],
                "white": [bool(((h == 0) & (s > 0)).any()) for h, s in found],
            }
        )

    lined = cut_lineage(map_frames(keyed(docs), lines, "doc long, tag long, lines array<long>, sizes array<int>, white boolean"))
    shorter = lined.where("white").limit(1).count() > 0

    def runs(frame: pd.DataFrame) -> list[np.ndarray]:
        return [run_hashes(np.asarray(x, np.int64), np.asarray(s, np.int64), min_chars, shorter) for x, s in zip(frame["lines"], frame["sizes"])]

    as_hashes = lambda f: np.concatenate(runs(f)) if len(f) else np.zeros(0, U64)
    bits = docs.sparkSession.sparkContext.broadcast(repeated_bits(lined.select("lines", "sizes"), as_hashes))  # 8 MB, fixed

    def repeated(frame: pd.DataFrame) -> pd.DataFrame:
        out = [signed(x[maybe_repeated(x, bits.value)]) for x in runs(frame)]
        count = np.array([len(x) for x in out], int)
        return pd.DataFrame(
            {"run": np.concatenate(out) if out else [], "doc": frame["doc"].to_numpy().repeat(count), "tag": frame["tag"].to_numpy().repeat(count)}
        )

    held = map_frames(lined.select("doc", "tag", "lines", "sizes"), repeated, "run long, doc long, tag long")
    holders = held.groupBy("run").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("doc", "tag")).alias("owner")).where("df > 1").drop("df")
    pairs = held.join(holders, "run").where("doc > owner.doc").select("doc", "tag", F.col("owner").alias("with")).distinct()
    once = lined.drop("white").dropDuplicates(["doc", "tag"])
    earlier = once.select(F.col("doc").alias("doc2"), F.col("tag").alias("tag2"), F.col("lines").alias("lines2"))
    both = pairs.join(once, ["doc", "tag"]).join(earlier, (F.col("with.doc") == F.col("doc2")) & (F.col("with.tag") == F.col("tag2")))

    def blocks(frame: pd.DataFrame) -> pd.DataFrame:
        found = [
            [{"first": a, "end": b} for a, b in common_blocks(np.asarray(x), np.asarray(s), np.asarray(y), min_chars)]
            for x, s, y in zip(frame["lines"], frame["sizes"], frame["lines2"])
        ]
        return pd.DataFrame({"doc": frame["doc"], "tag": frame["tag"], "blocks": found})

    found = map_frames(both.select("doc", "tag", "lines", "sizes", "lines2"), blocks, "doc long, tag long, blocks array<struct<first:int,end:int>>")
    return found.where(F.size("blocks") > 0).groupBy("doc", "tag").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))


def keep_lines(text: str, blocks) -> tuple[str, int, int]:
    """The text without the blocks, and its numbers of lines and of deleted lines."""
    lines = text.split("\n")
    n = len(lines) if text else 0
    if blocks is None or not len(blocks):
        return text, n, 0
    gone = np.zeros(len(lines), bool)
    for b in blocks:
        gone[b["first"] : b["end"]] = True
    return "\n".join([x for x, g in zip(lines, gone.tolist()) if not g]), n, int(gone.sum())


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, the kept text and its digest, of every row."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [keep_lines(t, b) for t, b in zip(frame["text"], frame["blocks"])]
        out = pd.DataFrame(rows, columns=["kept", "n_lines", "n_removed"])
        out["kept_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["kept"]]
        out.insert(0, "doc", frame["doc"].to_numpy())
        return out

    joined = keyed(docs).join(deleted_blocks(docs, min_chars), ["doc", "tag"], "left").select("doc", "text", "blocks")
    out = map_frames(joined, each, "doc long, kept string, n_lines long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_lines", "n_removed", "kept", "kept_sha256")
