"""Removal of every byte that a repeated string of ``width`` bytes covers.

All starts of a string of ``width`` bytes lie in runs with one anchor (see ``windows``),
so equal strings always meet under their anchor:

1. anchors with one place in the corpus are dropped; where all runs of an anchor are equal
   bytes, every start in them is repeated and no text is looked at;
2. the other runs are dealt out by anchor to shards of bounded bytes, each kind of run
   once.  A shard joins its runs to one string, builds its suffix array by induced
   sorting and the permuted common prefixes; a start is repeated if it shares ``width``
   bytes with the suffix before or after it in the order;
3. an anchor whose kinds of runs pass the shard's bound (a passage in very many unequal
   surroundings) has its starts counted by 128-bit hashes instead, which any number of
   tasks can share.  Neighbouring starts are settled together: a piece whose bytes occur
   twice is repeated as a whole, one whose bytes common to all its starts occur once holds
   no repeated start, and the others are cut into smaller pieces, with one of each of the
   repeated pieces that may hold the same starts.

Defined cases: a null text is empty and loses nothing; texts are read whole; rows equal
in id and text count as separate documents, so their strings repeat; an id may be null;
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
from .hashing import byte_values, covered, leftmost_minima, prefix_sums, runs, signed, span_hashes, window_hashes
from .inputs import map_frames
from .substrings import LAST, keyed
from .suffix_array import common_prefixes, suffix_array
from .windows import anchored_runs, starts_mask

RUNS = "anchor long, kind long, doc long, tag long, start int, n int, places int"
#: runs of repeated starts within a run, all in one row
HITS = "anchor long, kind long, spans array<struct<at:int,n:int>>"
PIECES = "anchor long, kind long, ats array<int>, n int, f1 long, f2 long, c1 long, c2 long"
#: most starts in a piece, round by round; each divides the one before
PIECE_STARTS = (64, 8, 1)
#: bytes of runs in a shard, and the most that one anchor may bring
SHARD_BYTES = 1 << 20
ANCHOR_BYTES = 2 << 20


def byte_runs(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Every run of every text."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, tag, text in zip(frame["doc"], frame["tag"], frame["text"]):
            anchor, start, n, kind, places = anchored_runs(byte_values(text.encode()), width, gram)
            if len(anchor):
                out.append((np.full(len(anchor), doc), np.full(len(anchor), tag), anchor, start, n, kind, places.astype(np.int32)))
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in RUNS.split(", ")})
        doc, tag, anchor, start, n, kind, places = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"anchor": signed(anchor), "kind": signed(kind), "doc": doc, "tag": tag, "start": start.astype(np.int32), "n": n.astype(np.int32), "places": places})

    return map_frames(texts, each, RUNS)


def repeated_starts(contents: list[bytes], width: int) -> list[np.ndarray]:
    """Starts in each of some unequal strings whose ``width`` bytes also start elsewhere in them."""
    joined = b"\xff".join(contents) + b"\xff"  # no byte of UTF-8 text
    raw = np.frombuffer(joined, np.uint8)
    order = suffix_array(np.r_[raw.astype(np.int64) + 1, 0], 257)
    before, shared = common_prefixes(joined + b"\x00", order)
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size + 1) - size - 1
    sound = np.zeros(len(joined) + 1, bool)  # starts with all their bytes inside one string
    for b, n in zip(base, size):
        sound[b : b + max(0, n - width + 1)] = True
    hit = np.flatnonzero((shared >= width) & sound & (before >= 0))
    twice = np.zeros(len(joined) + 1, bool)
    twice[hit] = True
    twice[before[hit]] = True
    twice &= sound
    return [np.flatnonzero(twice[b : b + n]) for b, n in zip(base, size)]


def fetch(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Runs with their bytes; rows equal in id and text give a run more than once."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "kind", "start", "n", "shard")).alias("runs"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, found in zip(frame["text"], frame["runs"]):
                data = text.encode()
                yield pd.DataFrame(
                    {
                        "anchor": [r["anchor"] for r in found],
                        "kind": [r["kind"] for r in found],
                        "shard": [r["shard"] for r in found],
                        "content": [data[r["start"] : r["start"] + r["n"] + width - 1] for r in found],
                    }
                )

    return texts.join(lists, ["doc", "tag"]).mapInPandas(each, "anchor long, kind long, shard long, content binary")


def spans_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of consecutive places."""
    a, b = runs(places - np.arange(len(places)))
    return places[a], b - a


def shard_hits(content: DataFrame, width: int) -> DataFrame:
    """Repeated starts by shard, from suffix arrays."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["anchor", "kind"])
        found = repeated_starts(frame["content"].tolist(), width)
        spans = [[{"at": at, "n": n} for at, n in zip(*(x.tolist() for x in spans_of(places)))] for places in found]
        out = pd.DataFrame({"anchor": frame["anchor"].to_numpy(), "kind": frame["kind"].to_numpy(), "spans": pd.Series(spans, dtype=object)})
        return out[[len(x) > 0 for x in spans]]

    return content.groupBy("shard").applyInPandas(each, HITS)


def start_pieces(data: bytes, width: int, gram: int, most: int, open_starts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Unequal pieces of neighbouring starts in the bytes of a run: their places, numbers of starts, and four hashes each.

    Places are told by the anchor's, from which equal strings start at equal distances.
    Two hashes name the bytes of the piece, two those that all starts within the same
    ``most`` distances cover.
    """
    values = byte_values(data)
    anchor = leftmost_minima(window_hashes(values, gram, salt=1), width - gram + 1)
    cell = (np.arange(len(anchor)) - anchor + width - gram) // most
    a, b = runs(anchor * (width + 1) + cell)
    if open_starts is not None:
        a, b = a[open_starts[a]], b[open_starts[a]]
    low = anchor[a] + cell[a] * most - (width - gram)
    names = []
    for salt, v in ((3, values), (4, values ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        sums = prefix_sums(v)
        names += [span_hashes(sums, a, b + width - 1, salt), span_hashes(sums, low + most - 1, low + width, salt)]
    names = np.stack([names[0], names[2], names[1], names[3]])
    # equal pieces of one run are one row
    order = np.lexsort((a, names[1], names[0]))
    names, a, b = names[:, order], a[order], b[order]
    first = np.flatnonzero(np.r_[True, (names[:2, 1:] != names[:2, :-1]).any(axis=0)]) if len(a) else a
    return np.split(a.astype(np.int32), first[1:]) if len(a) else [], (b - a)[first], names[:, first]


def pieces(content: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """Pieces of the runs; of the starts in ``todo`` only, where there is such a column."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, data in enumerate(frame["content"]):
            left = None
            if "todo" in frame:
                todo = frame["todo"].iloc[k]
                ats = [np.asarray(x["ats"]) for x in todo]
                left = starts_mask(np.concatenate(ats), np.repeat([x["n"] for x in todo], [len(x) for x in ats]), len(data) - width + 1)
            out.append(start_pieces(data, width, gram, most, left))
        which = np.repeat(np.arange(len(frame)), [len(n) for _, n, _ in out])
        names = np.concatenate([x for _, _, x in out], axis=1) if out else np.zeros((4, 0), np.uint64)
        return pd.DataFrame(
            {
                "anchor": frame["anchor"].to_numpy()[which],
                "kind": frame["kind"].to_numpy()[which],
                "ats": pd.Series([at for ats, _, _ in out for at in ats], dtype=object),
                "n": np.concatenate([n for _, n, _ in out]) if out else np.zeros(0, np.int64),
                **{c: signed(names[k]) for k, c in enumerate(("f1", "f2", "c1", "c2"))},
            }
        )

    return map_frames(content, each, PIECES)


def hashed_hits(content: DataFrame, width: int, gram: int) -> DataFrame:
    """Repeated starts of anchors too large for a shard, from hashes counted over all tasks."""
    # equal copies of a run (from equal rows) are one
    content = cut_lineage(content.dropDuplicates(["anchor", "kind"]).select("anchor", "kind", "content"))
    todo, hits = content, []
    for most in [m for m in PIECE_STARTS if m == 1 or 2 * m <= width]:
        made = cut_lineage(pieces(todo, width, gram, most))
        one = F.struct("anchor", "kind", F.slice("ats", 1, 1).alias("ats"), "n")
        equal = made.groupBy("f1", "f2", "c1", "c2").agg(F.sum(F.size("ats")).alias("times"), F.min(one).alias("one"))
        equal = cut_lineage(equal)
        hits.append(made.join(equal.where("times > 1"), ["f1", "f2", "c1", "c2"], "left_semi").select("anchor", "kind", "ats", "n"))
        # pieces met once go on, with one of each kind of those that may hold the same starts
        alike = equal.groupBy("c1", "c2").agg(F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1 and least = 1")
        rest = equal.join(alike, ["c1", "c2"], "left_semi").select("one.*")
        todo = content.join(rest.groupBy("anchor", "kind").agg(F.collect_list(F.struct("ats", "n")).alias("todo")), ["anchor", "kind"])
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    spans = F.flatten(F.collect_list(F.transform("ats", lambda at: F.struct(at.alias("at"), F.col("n").alias("n")))))
    return found.groupBy("anchor", "kind").agg(spans.alias("spans"))


def repeated_places(docs: DataFrame, width: int, gram: int | None = None, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """doc, tag and starts (lists of start and number) of repeated strings."""
    gram = gram or width // 4
    texts = keyed(docs)
    found = cut_lineage(byte_runs(texts, width, gram))
    anchors = (
        found.groupBy("anchor")
        .agg(F.sum("places").alias("all"), F.max("places").alias("most"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
        .where("all > 1")
        .select("anchor", ((F.col("k1") != F.col("k2")) | (F.col("most") > 1)).alias("mixed"))
    )
    repeated = cut_lineage(found.join(anchors, "anchor"))
    mixed = repeated.where("mixed")
    kinds = mixed.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "tag", "start", "n")).alias("first"))
    sizes = kinds.groupBy("anchor").agg(F.sum(F.col("first.n") + (width - 1)).alias("bytes"))
    kinds = cut_lineage(kinds.join(sizes, "anchor").select("anchor", "kind", "times", "first.*", "bytes"))
    fits = F.col("bytes") <= anchor_bytes
    total = kinds.agg(F.sum(F.when(fits, F.col("n") + (width - 1))).alias("b"), F.max(~fits).alias("large")).first()
    shards = int((total["b"] or 0) // SHARD_BYTES) + 1
    # -1 marks the anchors that no shard may hold
    routed = kinds.withColumn("shard", F.when(fits, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.lit(-1)))
    content = cut_lineage(fetch(routed, texts, width))
    hits = shard_hits(content.where("shard >= 0"), width)
    if total["large"]:
        hits = hits.unionByName(hashed_hits(content.where("shard < 0"), width, gram))
    # a run that occurs twice is repeated as a whole, whatever else its anchor holds
    whole = repeated.join(kinds.where("times > 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi").unionByName(repeated.where("not mixed"))
    whole = whole.select("doc", "tag", F.array(F.struct("start", "n")).alias("starts"))
    single = kinds.where("times = 1").select("anchor", "kind", "doc", "tag", "start")
    moved = F.transform("spans", lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["n"].alias("n")))
    inner = single.join(hits, ["anchor", "kind"]).select("doc", "tag", moved.alias("starts"))
    return whole.union(inner).groupBy("doc", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def removed_bytes(n: int, starts, width: int) -> np.ndarray:
    if starts is None or not len(starts):
        return np.zeros(n, bool)
    mask = starts_mask(np.array([s["start"] for s in starts]), np.array([s["n"] for s in starts]), n)
    return covered(np.flatnonzero(mask), width, n)


def kept_bytes(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of the removed runs) and kept_sha256 of every row."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, starts in zip(frame["text"], frame["starts"]):
            data = text.encode()
            gone = removed_bytes(len(data), starts, width)
            keep = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
            edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2])]
            rows.append((len(data), len(data) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept_sha256"])
        out.insert(0, "doc", frame["doc"].to_numpy())
        return out

    joined = keyed(docs).join(repeated_places(docs, width), ["doc", "tag"], "left").select("doc", "text", "starts")
    out = map_frames(joined, each, "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept_sha256")
