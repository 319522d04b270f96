"""Digests of long ordered lists whose entries never meet in one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SHA-256 of no bytes
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def ordered_sha256(parts: DataFrame, keys: Sequence[str], order: str, part: str, separator: str) -> DataFrame:
    """The keys and ``sha256``: lowercase hex over the parts of a key, in their order and joined by the separator.

    Parts are sorted on disk by Spark and go through one running hash state, a batch at a
    time, so a key's list may be of any length.
    """
    keys = list(keys)
    joined = separator.encode()
    fields = [f for f in parts.schema.fields if f.name in keys]
    schema = ", ".join(f"{n} {next(f.dataType.simpleString() for f in fields if f.name == n)}" for n in keys) + ", sha256 string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, empty = None, None, True
        for frame in frames:
            done = []
            for *key, text in frame[[*keys, part]].itertuples(index=False, name=None):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state, empty = key, hashlib.sha256(), True
                if not empty:
                    state.update(joined)
                state.update(text.encode())
                empty = False
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*keys, "sha256"])

    dealt = parts.select(*keys, order, part).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, schema)
