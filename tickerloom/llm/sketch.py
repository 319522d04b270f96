"""Count-min sketch of hashes, built per partition and merged; it only answers "twice or more?".

The sketch has a fixed number of cells (``ROWS`` times ``width``), so what the driver
receives and sends out is bounded whatever the input holds.  A hash that occurs twice
is always estimated as repeated; more input than cells makes the filter let more pass,
never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U64, mix

ROWS = 4
#: cells of a row; the merged bits of all rows take ROWS * WIDTH / 8 bytes (8 MB)
WIDTH = 1 << 24
CHUNK = 1 << 16


def cells(hashes: np.ndarray, width: int) -> np.ndarray:
    """The cell of every hash in each row, as numbers in one range."""
    return np.stack([(mix(hashes, 0x51ED27 + 7919 * r) & U64(width - 1)) + U64(r * width) for r in range(ROWS)])


def partition_sketch(hash_parts: Iterator[np.ndarray], width: int) -> Iterator[pd.DataFrame]:
    """Cells that a partition met, chunk by chunk, with those met more than once apart."""
    # hashes are gathered up to a bound, then counted; several rows for a chunk do no harm
    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        met, times = np.unique(cells(np.concatenate(parts), width).ravel(), return_counts=True)
        chunk = (met // U64(CHUNK)).astype(np.int64)
        inside = (met % U64(CHUNK)).astype("<u2")
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[cuts[1:], len(chunk)]
        once, more = [], []
        for a, b in zip(cuts, ends):
            twice = times[a:b] > 1
            once.append(inside[a:b][~twice].tobytes())
            more.append(inside[a:b][twice].tobytes())
        return pd.DataFrame({"chunk": chunk[cuts], "once": once, "more": more})

    waiting: list[np.ndarray] = []
    n = 0
    for part in hash_parts:
        if len(part):
            waiting.append(part)
            n += len(part)
        if n > 1_000_000:
            yield counted(waiting)
            waiting, n = [], 0
    if waiting:
        yield counted(waiting)


def repeated_bits(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], width: int = WIDTH, least: int = 2) -> np.ndarray:
    """Bits of the cells met ``least`` times (1 or 2) or more over all rows; ``hashes`` gives the hashes of a batch."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from partition_sketch((hashes(f) for f in frames), width)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition of this step has a share of the chunks, 64 KB each, and streams what tasks sent
        counts: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, once, more in zip(frame["chunk"], frame["once"], frame["more"]):
                have = counts.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                at = np.frombuffer(once, "<u2")
                have[at] = np.minimum(have[at] + 1, 2)
                have[np.frombuffer(more, "<u2")] = 2
        if counts:
            yield pd.DataFrame({"chunk": list(counts), "bits": [np.packbits(c >= least, bitorder="little").tobytes() for c in counts.values()]})

    parts = rows.mapInPandas(build, "chunk long, once binary, more binary")
    merged = parts.repartition("chunk").mapInPandas(merge, "chunk long, bits binary")
    out = np.zeros(ROWS * width // 8, np.uint8)
    size = CHUNK // 8
    for row in merged.toLocalIterator():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def maybe_repeated(hashes: np.ndarray, bits: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Mask of the hashes whose cells all have their bit: every hash met often enough, and few others."""
    c = cells(hashes, width)
    return ((bits[(c >> U64(3)).astype(np.int64)] >> (c & U64(7)).astype(np.uint8)) & 1).all(axis=0)


def maybe_among(wanted: DataFrame, *by: str) -> Column:
    """Condition on the columns (doc and tag if none are given) that holds for those of all wanted rows, and for few others (8 MB of bits, fixed)."""
    name = F.xxhash64(*(by or ("doc", "tag")))
    found = repeated_bits(wanted.select(name.alias("name")), lambda f: f["name"].to_numpy(np.int64).view(U64), least=1)
    bits = wanted.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def among(names: pd.Series) -> pd.Series:
        return pd.Series(maybe_repeated(names.to_numpy(np.int64).view(U64), bits.value))

    return among(name)
