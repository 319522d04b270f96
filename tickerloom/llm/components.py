"""Connected components of links as Spark joins; nothing is gathered on the driver but one count a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: links that a task joins at once
JOINED_ROWS = 200_000


def _stars(a: list, b: list) -> pd.DataFrame:
    """Links of every node with the smallest one it is linked with, directly or not, among these links."""
    codes, nodes = pd.factorize(pd.Series([*a, *b], dtype=object), sort=True)
    a, b = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[own], "b": nodes[root[own]]})


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) of the same components: each task turns what it reads into stars, some rows at a time."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for frame in frames:
            a += frame["a"].tolist()
            b += frame["b"].tolist()
            if len(a) >= JOINED_ROWS:
                yield _stars(a, b)
                a, b = [], []
        if a:
            yield _stars(a, b)

    return links.mapInPandas(each, links.schema)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it is linked with) for links (a, b).

    Links are first contracted, in the tasks that make them and again in splits of
    about JOINED_ROWS of the table written, which leaves few rounds.  Each round every node takes
    the smallest root among its neighbours, and then its root's root, so that chains
    shorten by half.
    """
    made = cut_lineage(contracted(links.select("a", "b").where("a <> b")))
    stars = contracted(made.coalesce(made.count() // JOINED_ROWS + 1))
    edges = cut_lineage(stars.withColumn("ends", F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).select(F.inline("ends")))
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("up"))
        roots = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = cut_lineage(lower.join(roots, "up").select("node", F.least("up", "top").alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
