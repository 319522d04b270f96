"""Jaccard join of n-gram sets with an R-tree over group counts.

The distinct shingles of a document are hashed into groups; the vector of group counts
is a point.  Two sets share at most the sum of the smaller counts, group by group, and
for a box of points at most the sum of minima with its upper corner, so the tree passes
over boxes and points that can't reach the overlap asked for; the pairs that survive
are verified on the sets.

Most sets link with none, and are put aside first: a set of n shingles of which u stand in
no other set shares at most n - u with any, so it can link only if n - u reaches the
threshold's share of n.  u is counted on a part of the shingles chosen by hash, which
only makes it smaller, so that no set that links is put aside.

The other points are dealt out by content.  Sets that link differ in at most D shingles
(D follows from the threshold and the largest size of their size class), so of D + r
groups at least r hold the same shingles in both.  A key is made of each group that
isn't empty (and of each two empty ones, of a set with r or more), so linked sets
always share a key, and a set with e empty groups shares r - e keys or more with any
that it links with.  Sets that have fewer keys in common with all others together are
left out of a size class, so that a group of few shingles, which unlike sets may have
in common, joins none.  The others that share keys form families.

The more sets there are, the more of them share enough keys by chance, and their families
grow together.  So a family of more than a block is split by its sets' rarest shingles: of two
that link, each has n shingles of which the other holds s or more (the threshold's share of n),
so with all shingles in one order, by the number of holders, the n - s + 1 rarest of both
have one in common.  Sets that share such a shingle form the families that are gone on with.

One family is joined in blocks: within each block, among the blocks' most central sets, and
then, only where a family still has several components, between its blocks.  Sets of one
component are never compared again, so a group of near copies costs about one comparison
for each.

Defined cases: a null, empty or blank text has no shingle and is linked with nothing;
with fewer words than a shingle takes the whole sequence is one; texts are read whole;
equal sets are one class; a null id counts as the largest (component_id is null where
no other id is in the component); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .hashing import U64, mix, signed, window_hashes, word_hashes
from .inputs import map_frames
from .sketch import maybe_among, maybe_repeated, repeated_bits
from .substrings import LAST, keyed

#: coordinates of a point
GROUPS = 64
#: share of the shingles looked at for those of one set alone, as a multiple of the share that linked sets may lack
SAMPLE_RATIO = 5 / 3
#: sets in a block of a family, and points in a leaf of the tree
BLOCK_ROWS = 1000
LEAF = 32
#: a size class ends at so many times its smallest size
CLASS_RATIO = 1.2
#: shingles of a frame of rows, about
ROWS_AT_ONCE = 200_000


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = word_hashes(text.encode().lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words)), salt=5))


def needed(total: int, percent: int) -> int:
    """The least overlap with 100 * overlap >= percent * union, for sizes that sum to total."""
    return -(-percent * total // (100 + percent))


@lru_cache(maxsize=4)
def class_bounds(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of every size class up to a limit."""
    low, lows, highs = 1, [], []
    while low <= limit:
        lows.append(low)
        highs.append(max(low, int(low * CLASS_RATIO)))
        low = highs[-1] + 1
    return np.array(lows), np.array(highs)


def class_keys(hashes: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Keys of a set for each size class it may link in, and how many it shares at least with any set it links with there."""
    n = len(hashes)
    if not n:
        return []
    # sets link with sets of up to 100 / percent of their size
    limit = 1 << max(12, int(100 * n // percent).bit_length())
    lows, highs = class_bounds(limit)
    own = int(np.searchsorted(lows, n, "right")) - 1
    out = []
    for c in range(own, len(lows)):
        if 100 * n < percent * lows[c]:
            break  # too small for this class and all after it
        high = int(highs[c])
        # the difference has the parity of the summed size, and grows with it among sums of one parity
        differ = max(total - 2 * needed(total, percent) for total in (2 * high - 1, 2 * high))
        if differ < 1:
            continue  # only equal sets link
        spare = 3 + differ // 8
        m = differ + spare
        group = (mix(hashes, 1000 + c) % U64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sums = np.r_[U64(0), np.cumsum(mix(hashes[order], 77))]
        count = np.bincount(group, minlength=m)
        ends = np.cumsum(count)
        full = np.flatnonzero(count)
        content = sums[ends[full]] - sums[ends[full] - count[full]]
        tag = U64(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        keys = mix(content + mix(full.astype(U64) + tag, 9))
        empty = np.flatnonzero(count == 0).astype(U64)
        if len(empty) >= spare:
            a, b = np.triu_indices(len(empty), 1)
            keys = np.r_[keys, mix(mix(empty[a] + tag, 10) + mix(empty[b], 11))]
        # of the groups alike, at least ``spare``, only the empty ones have no key
        out.append((keys, max(1, spare - len(empty))))
    return out


def group_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set; linked sets that aren't equal share at least one."""
    out = [keys for keys, _ in class_keys(hashes, percent)]
    return np.concatenate(out) if out else hashes[:0]


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc, tag, n (shingles), sig (128 bits of the set) and sample (hashes chosen by their value) of every row."""
    one_of = max(1, int(100 / (SAMPLE_RATIO * max(1, 100 - percent))))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, size) for t in frame["text"]]
        return pd.DataFrame(
            {
                "doc": frame["doc"],
                "tag": frame["tag"],
                "n": [len(s) for s in sets],
                "sig": [hashlib.md5(s.tobytes()).digest() for s in sets],
                "sample": [signed(s[s % U64(one_of) == 0]) for s in sets],
            }
        )

    return map_frames(keyed(docs), each, "doc long, tag long, n long, sig binary, sample array<long>")


def linkable(signed_docs: DataFrame, percent: int) -> DataFrame:
    """sig, n, doc and tag (of one row) of the sets that enough of their shingles share with others."""
    # 64 bits of the signature tell the sets of one shingle apart
    name = F.xxhash64("sig")
    held = signed_docs.select(name.alias("set"), F.explode("sample").alias("shingle"))
    alone = held.groupBy("shingle").agg(F.min("set").alias("set"), F.max("set").alias("other")).where("set = other")
    alone = alone.groupBy("set").agg(F.count(F.lit(1)).alias("alone"))
    sets = signed_docs.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc", "tag")).alias("at"), F.max("n").alias("n"))
    rows = sets.withColumn("set", name).join(alone, "set", "left")
    enough = 100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")
    return rows.where(enough).select("sig", "n", "at.doc", "at.tag")


def keyed_sets(texts: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """sig, keys (a list for each size class), needs (how many of each list a link takes) and shingles of the sets.

    They are made where the texts are read; no text is shuffled.

    Bits of the rows asked for (8 MB, fixed) keep most other texts out.  What else they
    let through is a set that was put aside, and has no place among the blocks.
    """
    name = F.xxhash64("doc", "tag").alias("name")
    wanted = repeated_bits(sets.select(name), lambda f: f["name"].to_numpy(np.int64).view(U64), least=1)
    bits = texts.sparkSession.sparkContext.broadcast(wanted)

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[maybe_repeated(frame["name"].to_numpy(np.int64).view(U64), bits.value)]
        made = [shingles(t, size) for t in frame["text"]]
        keys = [class_keys(s, percent) for s in made]
        # typed as objects, since a batch may have no row left
        return pd.DataFrame(
            {
                "sig": [hashlib.md5(s.tobytes()).digest() for s in made],
                "keys": pd.Series([[signed(k) for k, _ in lists] for lists in keys], dtype=object),
                "needs": pd.Series([[need for _, need in lists] for lists in keys], dtype=object),
                "shingles": [s.tobytes() for s in made],
            }
        )

    return map_frames(texts.select(name, "text"), each, "sig binary, keys array<array<long>>, needs array<int>, shingles binary")


def _met(held: DataFrame) -> DataFrame:
    """Rows whose key another set has too, with low, the smallest set of the key."""
    same = Window.partitionBy("key")
    return held.withColumn("low", F.min("set").over(same)).withColumn("high", F.max("set").over(same)).where("low <> high").drop("high")


def family_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between 64-bit names of sets that share a key and have enough shared ones for a link."""
    lists = sets.select(F.xxhash64("sig").alias("set"), F.posexplode(F.arrays_zip("keys", "needs")).alias("part", "list"))
    held = lists.select("set", "part", "list.needs", F.explode("list.keys").alias("key"))
    able = _met(held).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("set", "part"))).where("times >= needs")
    return _met(able.select("set", "key")).where("set <> low").select(F.col("set").alias("a"), F.col("low").alias("b"))


def shingle_rows(sets: DataFrame, percent: int) -> DataFrame:
    """set, least (shingles that a set it links with has of it) and key, one row for each shingle."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [np.frombuffer(x, U64) for x in frame["shingles"]]
            size = np.array([len(x) for x in made], np.int64)
            # some sets at a time: texts may be long
            part = np.cumsum(size) // ROWS_AT_ONCE
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                n = size[at]
                least = -(-percent * n // 100)
                keys = signed(np.concatenate([made[i] for i in at]))
                yield pd.DataFrame({"set": np.repeat(frame["set"].to_numpy()[at], n), "least": np.repeat(least, n).astype(np.int32), "key": keys})

    return sets.select("set", "shingles").mapInPandas(each, "set long, least int, key long")


def rare_links(held: DataFrame) -> DataFrame:
    """Links (a, b) between sets that have one of their rarest shingles in common; any two that link are joined by them.

    Counted from the most frequent shingle on, the rarest are those from place ``least``;
    the shingles of one set alone come last, and need no place.
    """
    met = _met(held).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key")))
    order = Window.partitionBy("set").orderBy(F.col("times").desc(), F.col("key").desc())
    # equal rows of a set have one place
    rare = met.withColumn("place", F.dense_rank().over(order)).where("place >= least")
    return _met(rare.select("set", "key")).where("set <> low").select(F.col("set").alias("a"), F.col("low").alias("b"))


def split_families(family: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """set and family, with the families of more than a block split by their sets' rarest shingles."""
    wide = family.groupBy("family").count().where(F.col("count") > block_rows).select("family")
    inside = cut_lineage(family.join(wide, "family", "left_semi"))
    if inside.limit(1).count() == 0:
        return family
    named = sets.select(F.xxhash64("sig").alias("set"), "shingles")
    held = shingle_rows(named.where(maybe_among(inside, "set")).join(inside.select("set"), "set"), percent)
    finer = components(rare_links(held)).select(F.col("node").alias("set"), F.col("root").alias("family"))
    return family.join(wide, "family", "left_anti").select("set", "family").unionByName(finer)


class CountTree:
    """Two levels of boxes over count vectors, packed in the order of size and place."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        spread = points[:, np.argsort(points.var(axis=0))[::-1][:4]]
        self.order = np.lexsort((*spread.T, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.leaf_starts = np.arange(0, len(points), LEAF)
        self.leaf_high = np.maximum.reduceat(self.points, self.leaf_starts, axis=0)
        self.leaf_least = np.minimum.reduceat(self.sizes, self.leaf_starts)
        self.node_starts = np.arange(0, len(self.leaf_starts), LEAF)
        self.node_high = np.maximum.reduceat(self.leaf_high, self.node_starts, axis=0)
        self.node_least = np.minimum.reduceat(self.leaf_least, self.node_starts)

    def reach(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose sum of minima with the point reaches the overlap asked for."""
        enough = lambda high, least: np.minimum(high, point).sum(axis=1) * (100 + percent) >= percent * (size + least)
        nodes = np.flatnonzero(enough(self.node_high, self.node_least))
        leaves = (self.node_starts[nodes][:, None] + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.leaf_starts)]
        leaves = leaves[enough(self.leaf_high[leaves], self.leaf_least[leaves])]
        rows = (self.leaf_starts[leaves][:, None] + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.points)]
        return self.order[rows[enough(self.points[rows], self.sizes[rows])]]


def group_counts(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((mix(hashes, 31) % U64(GROUPS)).astype(np.int64), minlength=GROUPS)


def link_sets(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], int]:
    """Links that join all components among the sets (not every link), and the most central set.

    ``labels`` are the components known so far.
    """
    points = np.stack([group_counts(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    labels = labels.copy()
    by_middle = np.argsort(np.abs(points - np.median(points, axis=0)).sum(axis=1), kind="stable")
    tree = CountTree(points, sizes)
    out = []
    for q in by_middle.tolist():
        if (labels == labels[0]).all():
            break
        near = tree.reach(points[q], int(sizes[q]), percent)
        for r in near[labels[near] != labels[q]].tolist():
            if labels[r] == labels[q]:
                continue  # joined since
            total = len(sets[q]) + len(sets[r])
            both = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
            if both >= needed(total, percent):
                out.append((q, r))
                labels[labels == labels[r]] = labels[q]
    return out, int(by_middle[0])


LINKS = "a binary, b binary, central boolean"


def _linker(percent: int):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("sig")
        sets = [np.frombuffer(x, U64) for x in frame["shingles"]]
        known = pd.factorize(frame["root"])[0] if "root" in frame else np.arange(len(frame))
        found, middle = link_sets(sets, known, percent)
        sig = frame["sig"].tolist()
        rows = [(sig[a], sig[b], False) for a, b in found] + [(sig[middle], sig[middle], True)]
        return pd.DataFrame(rows, columns=["a", "b", "central"])

    return each


def _code(band: Column, part: Column) -> Column:
    """Number of a block from its size band and its part of the band."""
    return (band.cast("long") * (1 << 24) + part.cast("long")).alias("code")


def placed(sets: DataFrame, place: DataFrame) -> DataFrame:
    """Sets with their place; those that have none are left out before any shuffle."""
    return sets.where(maybe_among(place, "sig")).join(place, "sig")


def set_links(signed_docs: DataFrame, texts: DataFrame, size: int, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between signatures that join every component."""
    able = cut_lineage(linkable(signed_docs, percent))
    sets = cut_lineage(keyed_sets(texts, able, size, percent))
    family = components(family_links(sets)).select(F.col("node").alias("set"), F.col("root").alias("family"))
    family = split_families(family, sets, percent, block_rows)
    members = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    # a family of several blocks is cut by size: sets link within a band or with the next one only
    wide_family = F.col("members") > block_rows
    band = F.when(wide_family, F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent)))).otherwise(F.lit(0)).cast("int")
    place = able.select("sig", "n", F.xxhash64("sig").alias("set")).join(family, "set").join(members, "family")
    place = cut_lineage(place.select("family", "sig", wide_family.alias("wide"), band.alias("band")))
    bands = place.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    place = place.join(bands, ["family", "band"]).withColumn("block", _code(F.col("band"), F.pmod(F.xxhash64("sig"), F.col("parts")))).drop("parts")
    sets = cut_lineage(placed(sets.select("sig", "shingles"), place))
    link = _linker(percent)
    first = cut_lineage(sets.groupBy("family", "block").applyInPandas(link, LINKS))
    wide = sets.where("wide")
    if wide.limit(1).count() == 0:
        return first.where("not central").select("a", "b")
    # the central sets of a family's blocks
    hubs = wide.join(first.where("central").select(F.col("a").alias("sig")), "sig")
    counted = bands.groupBy("family").agg(F.ceil(F.sum("parts") / block_rows).alias("hub_blocks"))
    hubs = hubs.join(counted, "family").withColumn("block", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("hub_blocks")).cast("long"))
    links = cut_lineage(first.unionByName(hubs.groupBy("family", "block").applyInPandas(link, LINKS)).where("not central").select("a", "b"))
    # families that are still apart: every two blocks of sizes that can link
    root = components(links).withColumnRenamed("node", "sig")
    known = wide.join(root, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    apart = known.groupBy("family").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("family")
    pairs = known.join(apart, "family", "left_semi")
    near = [bands.select("family", (F.col("band") - d).alias("band"), F.lit(d).alias("step"), "parts") for d in (-1, 0, 1)]
    # for each band the blocks of its own and of the two bands beside it
    beside = near[0].union(near[1]).union(near[2])
    beside = beside.groupBy("family", "band").agg(
        F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: _code(F.col("band") + F.col("step"), k)))).alias("others")
    )
    pairs = pairs.join(beside, ["family", "band"]).withColumn("other", F.explode("others")).drop("others").where("block <> other")
    pairs = pairs.withColumn("lower", F.least("block", "other")).withColumn("upper", F.greatest("block", "other"))
    between = pairs.groupBy("family", "lower", "upper").applyInPandas(link, LINKS).where("not central").select("a", "b")
    return links.union(between)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc, tag, n_shingles, component_id and keep (true for the first row's id and text of a component) of every row."""
    texts = keyed(docs)
    signed_docs = cut_lineage(signatures(docs, size, percent))
    root = components(set_links(signed_docs, texts, size, percent)).withColumnRenamed("node", "sig")
    rows = signed_docs.select("doc", "tag", "n", "sig").join(root, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rows = cut_lineage(rows.select("doc", "tag", "n", "root"))
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("first"))
    out = rows.join(first, "root", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc",
        "tag",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("first.doc")).alias("component_id"),
        (alone | ((F.col("doc") == F.col("first.doc")) & (F.col("tag") == F.col("first.tag")))).alias("keep"),
    )


def component_rows(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return near_duplicates(docs, size, percent).select(known("doc").alias("doc_id"), "n_shingles", known("component_id").alias("component_id"))
