"""Packing of token pieces into sequences by bin completion.

Only the lengths matter, so the search works on the histogram of piece lengths (at most
as many rows as a sequence has places, whatever the corpus holds): while pieces are
left, the longest one opens a sequence and the fillings around it are enumerated by
branch and bound.  A filling is a set of lengths that fit beside it; one that another
dominates (equal count of places replaced by a longer length that is left and still
fits) is skipped, a branch is cut when its waste bound can't beat the incumbent, and
the first incumbent is the best-fit filling.  The filling found is used as often as the
histogram allows, and so the number of fillings stays small for any number of pieces.

Pieces then find their places by rank among equal lengths: ranks come from counts per
(hash block, length) and a window inside each block, never from a window on a length.

Defined cases: a null text is an empty document (its end mark alone); longer documents
are cut into full pieces with the shorter piece first; equal rows each give their
pieces; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inputs import id_and_text, map_frames

PIECES = "doc_id long, text_tag long, piece int, start long, length int, ids_crc32 long"


#: white space so long that the matcher of ranks may run out of stack
_LONG_BLANK = re.compile(r"\s{1000}")


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a tokenizer file that is plain byte-level BPE with merges in the order of their ids; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not (plain and split) or spec.get("normalizer"):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or made and made[0] < 0:
        return None
    # a word of the vocabulary that no merge makes isn't a rank
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and (len(t) == 1 or i >= made[0])}
    return ranks if len(ranks) == 256 + len(made) else None


class Ids:
    """Ids of a text from a tokenizer file.

    Plain byte-level BPE gives the same ids from its ranks, at a fraction of the time.  Texts
    that hold the string of an added token, or very long white space, and tokenizers of
    any other kind go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = byte_level_ranks(path)
        ranks = {t: i for t, i in ranks.items() if i not in self.whole.get_added_tokens_decoder()} if ranks else None
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def __call__(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.added) or _LONG_BLANK.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_ids: dict[str, Ids] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; only the first may be shorter."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        if tokenizer_path not in _ids:
            _ids[tokenizer_path] = Ids(tokenizer_path)
        encode, end = _ids[tokenizer_path], np.array([end_id], "<u4").tobytes()
        rows = []
        for doc, tag, text in zip(frame["doc_id"], frame["text_tag"], frame["text"]):
            ids = encode(text) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            at = 0
            for k, size in enumerate([first, *[capacity] * ((n - first) // capacity)]):
                rows.append((doc, tag, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                at += size
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    keyed = id_and_text(docs, id_col, text_col).withColumn("text_tag", F.xxhash64("text"))
    return map_frames(keyed, each, PIECES)


def best_filling(longest: int, counts: list[int], capacity: int, most_nodes: int = 20_000) -> list[int]:
    """Lengths that fill a sequence around its longest piece with the least waste found.

    counts[length] is how many pieces are left (the longest itself already taken).  The
    search ends at no waste, when all undominated fillings are seen, or after
    ``most_nodes`` nodes; the incumbent is the best-fit filling at the start.
    """
    room = capacity - longest
    lengths = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    best, left, used = [], room, Counter()
    for n in lengths:  # best fit: always the longest piece that still goes in
        while n <= left and used[n] < counts[n]:
            best.append(n)
            used[n] += 1
            left -= n
    waste = left
    if not waste or not lengths:
        return best
    below = [0] * (len(lengths) + 1)  # places that the lengths from here on could take at most
    for i in range(len(lengths) - 1, -1, -1):
        below[i] = below[i + 1] + lengths[i] * counts[lengths[i]]
    nodes = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and waste and nodes < most_nodes:
        at, left, taken = stack.pop()
        nodes += 1
        if left - below[at] >= waste and left >= waste:
            continue  # even all that remains leaves as much
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if at == len(lengths):
            if left < waste:
                waste, best = left, list(taken)
            continue
        n = lengths[at]
        most = min(counts[n], left // n)
        # fewer of this length first on the stack, so that the fullest branch is tried first
        for k in range(most + 1):
            rest = left - k * n
            if k < most and at + 1 == len(lengths):
                continue  # dominated: one more of the same still fits
            if rest < waste:
                waste, best = rest, [*taken, *[n] * k]
            if rest:
                stack.append((at + 1, rest, (*taken, *[n] * k)))
    return best


def plan_fillings(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many sequences use each; every piece of the histogram is placed once."""
    counts = [0] * (capacity + 1)
    for n, k in histogram.items():
        counts[n] = k
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            filling = [longest, *best_filling(longest, counts, capacity)]
            counts[longest] += 1
            need = Counter(filling)
            times = min(counts[n] // k for n, k in need.items())
            for n, k in need.items():
                counts[n] -= k * times
            out.append((tuple(filling), times))
    return out


def slots(spark: SparkSession, plan: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """Rows (length, low, high, per, nth, first, offset): ranks low..high-1 of a length.

    A filling that holds a length ``per`` times takes that many ranks for each of its
    sequences; the nth of them stands at ``offset``.  Sequences are numbered from ``first``.
    """
    taken: Counter = Counter()
    rows, first = [], 0
    for filling, times in plan:
        need, seen, offset = Counter(filling), Counter(), 0
        for n in filling:
            rows.append((n, taken[n], taken[n] + need[n] * times, need[n], seen[n], first, offset))
            seen[n] += 1
            offset += n
        for n, k in need.items():
            taken[n] += k * times
        first += times
    return spark.createDataFrame(rows, "length int, low long, high long, per long, nth long, first long, offset long")


def ranked(pieces_: DataFrame, blocks: int) -> DataFrame:
    """Rank of every piece among those of its length, from 0."""
    block = F.pmod(F.xxhash64("doc_id", "text_tag", "piece"), F.lit(blocks)).cast("int")
    keyed = pieces_.withColumn("block", block)
    per_block = keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_block.select("length", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("block", "length").orderBy("doc_id", "text_tag", "piece")
    return (
        keyed.join(ahead, ["length", "block"])
        .withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)
        .drop("ahead", "block")
    )


def pack(pieces_: DataFrame, capacity: int, rows_per_block: int = 50_000) -> DataFrame:
    """sequence_id and offset for every piece.  ``pieces_`` should be a written table: it is read three times.

    The slot table has a few rows for each filling, and the fillings number at most a few
    thousand for 1024 lengths; it is joined on the length and narrowed to the one range
    that holds the rank.
    """
    spark = pieces_.sparkSession
    histogram = {r["length"]: r["k"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("k")).collect()}
    table = slots(spark, plan_fillings(histogram, capacity))
    blocks = max(1, sum(histogram.values()) // rows_per_block)
    ranges = table.groupBy("length").agg(
        F.sort_array(F.collect_set(F.struct("low", "high", "per", "first"))).alias("ranges"),
    )
    # a length is used by few fillings in their order; the range is found in the sorted list
    placed = ranked(pieces_, blocks).join(F.broadcast(ranges), "length")
    placed = placed.withColumn("r", F.element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1))
    k = F.col("rank") - F.col("r.low")
    placed = placed.select(
        *pieces_.columns,
        (F.col("r.first") + F.floor(k / F.col("r.per"))).cast("long").alias("sequence_id"),
        F.pmod(k, F.col("r.per")).alias("nth"),
        F.col("r.first").alias("first"),
    )
    offsets = table.select("length", "first", "nth", "offset")
    return placed.join(F.broadcast(offsets), ["length", "first", "nth"]).drop("first", "nth")
