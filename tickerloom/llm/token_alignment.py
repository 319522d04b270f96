"""Alignment of two tokenizers' tokens by their byte ranges, with a monoid of fragments.

A text, with a space before it, is a row of bytes that both tokenizers cut into tokens.
Tokens that end in one byte-range chunk make a fragment: the tokens up to the first
offset where one of each ends (an open prefix), the groups closed between such offsets,
and the tokens after the last one (an open suffix); a chunk without such an offset is
open as a whole.  Fragments compose: the suffix of one and the prefix of the next close a
group, or stay open.  Composition is associative, so chunks may be joined in any tree.

Texts are cut into segments of about ``SEGMENT`` bytes, at spaces that no token of either
vocabulary reaches across, and the segments of a long text go to different tasks.  The
fragments of a segment are composed there; those of a text with several segments go up a
tree of Spark groups with ``FAN`` children each.  Only open ends go through the tree;
closed groups stay in the written table and enter the digest in order through a running
hash state.

Two tokens that end together have the property that the bytes of one end with those of
the other, so the vocabularies bound the pairs that any corpus can link (some hundred
thousand).  Their counts are aggregated by Spark and sent to the tasks as one array.

Defined cases: a null or empty text, and one whose joined bytes differ from its own, has
zeros and an empty ``groups_sha256`` and adds nothing to the counts; texts of any length
are read whole (a run without such a space stays one segment); equal rows, also with
null ids, each give a row and count each; an empty table gives no rows; other columns of
the table are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .best_fit import _LONG_BLANK, byte_level_ranks
from .digests import ordered_sha256
from .inputs import id_and_text

#: bytes of a chunk and of a segment, and fragments that a node of the tree joins
CHUNK, SEGMENT, FAN = 8192, 32768, 16

#: a space that begins a word: neither pattern nor vocabulary reaches across the place before it
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.zeros(0, np.int32)


@dataclass
class Fragment:
    """Tokens of consecutive bytes.  If nothing is closed, all of them are in the prefix."""

    closed: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[str] = field(default_factory=list)
    n_groups: int = 0
    links: list[tuple] = field(default_factory=list)
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))


def joined(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def group_text(group: tuple[list[int], list[int]]) -> str:
    return "|".join(",".join(map(str, side)) for side in group)


def last_pair(group: tuple[list[int], list[int]]) -> tuple:
    return np.array(group[0][-1:], np.int64), np.array(group[1][-1:], np.int64)


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of the bytes of both; ``Fragment()`` is its neutral element."""
    if not f.closed:
        return Fragment(g.closed, joined(f.prefix, g.prefix), g.groups, g.n_groups, g.links, g.suffix)
    if not g.closed:
        return Fragment(True, f.prefix, f.groups, f.n_groups, f.links, joined(f.suffix, g.prefix))
    between = joined(f.suffix, g.prefix)
    groups, links = [*f.groups, group_text(between), *g.groups], [*f.links, last_pair(between), *g.links]
    return Fragment(True, f.prefix, groups, f.n_groups + 1 + g.n_groups, links, g.suffix)


class PairTexts(dict):
    """Text of a group of one token of each side; filled as pairs occur, and there are no more than the vocabularies allow."""

    def __missing__(self, pair: int) -> str:
        text = self[pair] = f"{pair >> 32}|{pair & 0xFFFFFFFF}"
        return text


class IdTexts(dict):
    """Decimal ids, filled as they occur."""

    def __missing__(self, i: int) -> str:
        text = self[i] = str(i)
        return text


_texts, _ids = PairTexts(), IdTexts()


def closed_text(a: np.ndarray, last_a: np.ndarray, b: np.ndarray, last_b: np.ndarray) -> str:
    """Groups of tokens, given the place of each group's last token on both sides."""
    texts = list(map(_texts.__getitem__, ((a[last_a] << 32) | b[last_b]).tolist()))
    from_a, from_b = np.r_[0, last_a[:-1] + 1], np.r_[0, last_b[:-1] + 1]
    longer = np.flatnonzero((last_a > from_a) | (last_b > from_b))
    a, b = a.tolist(), b.tolist()
    for k, i, j, m, n in zip(*(x.tolist() for x in (longer, from_a[longer], last_a[longer] + 1, from_b[longer], last_b[longer] + 1))):
        texts[k] = ",".join([_ids[x] for x in a[i:j]]) + "|" + ",".join([_ids[x] for x in b[m:n]])
    return ";".join(texts)


def chunk_fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in one chunk."""
    if not len(a) or not len(b):
        return Fragment(prefix=(a.tolist(), b.tolist()))
    near = np.minimum(np.searchsorted(b_ends, a_ends), len(b) - 1)
    at_a = np.flatnonzero(b_ends[near] == a_ends)
    at_b = near[at_a]
    if not len(at_a):
        return Fragment(prefix=(a.tolist(), b.tolist()))
    first = (a[: at_a[0] + 1].tolist(), b[: at_b[0] + 1].tolist())
    rest = (a[at_a[-1] + 1 :].tolist(), b[at_b[-1] + 1 :].tolist())
    if len(at_a) == 1:
        return Fragment(True, first, suffix=rest)
    in_a, in_b = a[at_a[0] + 1 : at_a[-1] + 1], b[at_b[0] + 1 : at_b[-1] + 1]
    text = closed_text(in_a, at_a[1:] - at_a[0] - 1, in_b, at_b[1:] - at_b[0] - 1)
    return Fragment(True, first, [text], len(at_a) - 1, [(a[at_a[1:]], b[at_b[1:]])], rest)


def segment_fragment(
    a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, start: int = 0, chunk: int = CHUNK
) -> Fragment:
    """The fragments of a segment's chunks, composed.  Ends are offsets in the document, past ``start``."""
    end = max(a_ends[-1] if len(a_ends) else start, b_ends[-1] if len(b_ends) else start)
    bounds = [*range((start // chunk + 1) * chunk, int(end), chunk), int(end)]
    cut_a, cut_b = (np.searchsorted(e, bounds, side="right") for e in (a_ends, b_ends))
    parts = []
    for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b):
        parts.append(chunk_fragment(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m]))
    return reduce(compose, parts, Fragment())


class TokenBytes:
    """The bytes of all tokens in one row, to compare many at once."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.row = np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, ids: np.ndarray, data: np.ndarray) -> bool:
        """Do the tokens, none of them empty, join to the data?"""
        length = self.length[ids]
        if length.sum() != len(data) or not length.all():
            return False
        shift = self.first[ids] - (np.cumsum(length) - length).astype(np.int32)
        at = np.arange(len(data), dtype=np.int32) + np.repeat(shift, length)
        return bool((self.row[at] == data).all())


class Pair:
    """Two tokenizers: the ids of their tokens, the bytes these stand for, and the pairs that may end together."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary with its usual pattern is asked for")
        model = pb.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, rules = pb.ModelProto.SentencePiece, model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("texts have to be taken as they are, with a space before them")
        if any("▁" in p.piece.lstrip("▁") for p in model.pieces if p.type == kinds.NORMAL):
            raise ValueError("an entry reaches across the beginning of a word")
        self.a_path, self._library = a_path, None
        ranks = byte_level_ranks(a_path)
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)

        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = spec["model"]["vocab"]
        self.a_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", ()))]))
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b_bytes = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.b_bytes[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.NORMAL:
                self.b_bytes[i] = p.piece.replace("▁", " ").encode()
        self.a_table, self.b_table = TokenBytes(self.a_bytes), TokenBytes(self.b_bytes)
        self.a_len, self.b_len = self.a_table.length, self.b_table.length
        self.codes = self._codes()
        # a pair's place by a hash of it; of pairs with one hash the last has the place
        self.hashed = np.zeros(1 << 21, np.int32)
        self.hashed[self._hash(self.codes)] = np.arange(len(self.codes))

    def _codes(self) -> np.ndarray:
        """All pairs of which one token's bytes end with the other's, as id of A times 2^32 plus id of B, sorted."""
        found = []
        sides = []
        for tokens in (self.a_bytes, self.b_bytes):
            held = defaultdict(list)
            for i, x in enumerate(tokens):
                if x:
                    held[x].append(i)
            sides.append(held)
        for a, x in enumerate(self.a_bytes):
            found += [(a << 32) | b for cut in range(len(x)) for b in sides[1].get(x[cut:], ())]
        for b, x in enumerate(self.b_bytes):
            found += [(a << 32) | b for cut in range(len(x)) for a in sides[0].get(x[cut:], ())]
        return np.unique(np.array(found, np.int64))

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        mixed = (pairs ^ (pairs >> 32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pairs.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(43)).astype(np.int64)

    def code(self, links: list[tuple]) -> np.ndarray:
        """Places in ``codes`` of linked ids."""
        if not links:
            return _NONE
        a, b = (np.concatenate([x[k] for x in links]).astype(np.int64) for k in (0, 1))
        return self.places((a << 32) | b)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        place = self.hashed[self._hash(pairs)]
        other = np.flatnonzero(self.codes[place] != pairs)
        place[other] = np.searchsorted(self.codes, pairs[other])
        return place

    @property
    def library(self):
        """The tokenizer of A itself, loaded where it is needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.a_path)
            self._library.encode_special_tokens = True
        return self._library

    def a_ids(self, text: str) -> list[int]:
        """Ids from the ranks, which plain byte-level BPE gives alike at a fifth of the time; very long white space needs the tokenizer."""
        if self.ranked is None or _LONG_BLANK.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def tokens(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both sides for texts that begin with a space, and whether both stand for the text's bytes."""
        for text in texts:
            a, b = np.array(self.a_ids(text), np.int64), np.array(self.b.encode(text[1:], num_threads=1), np.int64)
            data = np.frombuffer(text.encode(), np.uint8)
            # merges of bytes stand for them as they are, so lengths tell of A; B has marks for spaces
            yield a, b, int(self.a_len[a].sum()) == len(data) and self.b_table.same(b, data)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
        gc.freeze()
    return _pairs[a_path, b_path]


def segments(text: str, size: int = SEGMENT) -> list[tuple[int, str]]:
    """(first byte, text) of the parts of a text; a part ends at the first safe space at or past a multiple of the size."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    offsets = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    cuts = np.array([m.start() for m in _CUT.finditer(text)], np.int64)
    at = np.searchsorted(offsets[cuts], np.arange(size, offsets[-1], size))
    chosen = [0, *np.unique(cuts[at[at < len(cuts)]]).tolist(), len(text)]
    return [(int(offsets[i]), text[i:j]) for i, j in zip(chosen, chosen[1:]) if j > i]


SEGMENTS = "rid long, doc_id string, no int, parts int, start long, text string"
OPEN = "closed boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>"
FRAGMENTS = f"rid long, doc_id string, no int, parts int, ok boolean, n_a long, n_b long, n_groups long, links array<int>, groups string, sha256 string, {OPEN}"


def fragment_rows(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each segment.  A text of one segment is whole: it has its digest, and no open ends."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pair(a_path, b_path)
        for frame in frames:
            out = []
            keys = frame[["rid", "doc_id", "no", "parts", "start"]].itertuples(index=False, name=None)
            for (rid, doc_id, no, parts, start), (a, b, ok) in zip(keys, both.tokens(frame["text"])):
                if not ok:
                    out.append((rid, doc_id, no, parts, False, 0, 0, 0, [], None, "", False, [], [], [], []))
                    continue
                f = segment_fragment(a, start + np.cumsum(both.a_len[a]), b, start + np.cumsum(both.b_len[b]), start)
                sha = None
                if parts == 1:  # nothing stands before it, so its prefix is a group
                    f = compose(Fragment(True), f)
                    sha, f.groups = hashlib.sha256(";".join(f.groups).encode()).hexdigest(), []
                groups = ";".join(f.groups) if f.groups else None
                out.append((rid, doc_id, no, parts, True, len(a), len(b), f.n_groups, both.code(f.links), groups, sha, f.closed, *f.prefix, *f.suffix))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAGMENTS.split(", ")])

    return rows.mapInPandas(each, FRAGMENTS)


def text_segments(texts: DataFrame, size: int) -> DataFrame:
    """Rows for the segments of texts longer than one, dealt to tasks."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rid, doc_id, text in frame[["rid", "doc_id", "text"]].itertuples(index=False, name=None):
                parts = segments(text, size)
                yield pd.DataFrame([(rid, doc_id, no, len(parts), start, part) for no, (start, part) in enumerate(parts)], columns=["rid", "doc_id", "no", "parts", "start", "text"])

    return texts.mapInPandas(each, SEGMENTS).repartition("rid", "no")


CLOSING = f"rid long, no int, at int, groups string, link_a int, link_b int, {OPEN}"


def tree_level(nodes: DataFrame) -> DataFrame:
    """Composes up to ``FAN`` neighbours: a row for each parent, and one (with ``groups``) for each group closed on the way."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        rid, up = frame["rid"].iloc[0], int(frame["no"].iloc[0]) // FAN
        out, f, at = [], Fragment(), -1
        for place, closed, *ends in frame[["at", "closed", "pa", "pb", "sa", "sb"]].itertuples(index=False, name=None):
            pa, pb, sa, sb = (list(x) for x in ends)
            g = Fragment(bool(closed), (pa, pb), suffix=(sa, sb))
            if f.closed and g.closed:
                between = joined(f.suffix, g.prefix)
                out.append((rid, up, place, group_text(between), between[0][-1], between[1][-1], None, None, None, None, None))
            elif g.closed:
                at = place
            f = compose(f, g)
            f.groups, f.links, f.n_groups = [], [], 0
        out.append((rid, up, at, None, None, None, f.closed, *f.prefix, *f.suffix))
        whole = pd.DataFrame(out, columns=[c.split()[0] for c in CLOSING.split(", ")])
        return whole.astype({"link_a": "Int32", "link_b": "Int32"})

    return nodes.groupBy("rid", F.floor(F.col("no") / FAN).alias("up")).applyInPandas(each, CLOSING)


def closing_groups(fragments: DataFrame) -> DataFrame:
    """(rid, at, groups, link_a, link_b) of the groups that lie in several segments, or begin one, by the segment they end in."""
    nodes = fragments.select("rid", "no", F.col("no").alias("at"), *[c.split()[0] for c in OPEN.split(", ")])
    wanted = ["rid", "at", "groups", "link_a", "link_b"]
    most = fragments.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
    closed = None
    while True:
        level = cut_lineage(tree_level(nodes))
        found = level.where(F.col("groups").isNotNull()).select(*wanted)
        closed = found if closed is None else closed.unionByName(found)
        nodes = level.where(F.col("groups").isNull()).drop("groups", "link_a", "link_b")
        most = -(-most // FAN)
        if most <= 1:
            break
    # a text begins and ends where tokens of both sides do: its first group is the prefix, and no suffix is left
    first = [F.array_join(c, ",") for c in ("pa", "pb")]
    top = nodes.where("closed").select("rid", "at", F.concat_ws("|", *first).alias("groups"), F.get("pa", F.size("pa") - 1).alias("link_a"), F.get("pb", F.size("pb") - 1).alias("link_b"))
    return closed.unionByName(top)


def link_counts(links: DataFrame, n: int) -> np.ndarray:
    """Links of the corpus by pair: no more rows than the vocabularies have pairs that can end together."""
    got = links.select(F.explode("links").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(n, np.int64)
    counts[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def with_counts(links: DataFrame, counts: np.ndarray, best: np.ndarray, keep: list[str]) -> DataFrame:
    """n_links, n_best and count_sum for each row's links."""
    sent = links.sparkSession.sparkContext.broadcast((counts, best))
    types = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + ["n_links long", "n_best long", "count_sum long"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best = sent.value
        for frame in frames:
            of = [np.asarray(x, np.int64) for x in frame["links"]]
            out = frame[keep].copy()
            out["n_links"] = [len(x) for x in of]
            out["n_best"] = [int(best[x].sum()) for x in of]
            out["count_sum"] = [int(counts[x].sum()) for x in of]
            yield out

    return links.select(*keep, "links").mapInPandas(each, schema)


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    both = pair(a_path, b_path)
    texts = id_and_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    # ids travel as text: a batch with a null id would turn numbers into doubles
    marked = texts.select("rid", F.col("doc_id").cast("string"), F.concat(F.lit(" "), "text").alias("text"))
    short = marked.where((F.octet_length("text") > 1) & (F.octet_length("text") <= segment))
    one = short.select("rid", "doc_id", F.lit(0).alias("no"), F.lit(1).alias("parts"), F.lit(0).cast("long").alias("start"), "text")
    none = marked.where(F.octet_length("text") <= 1).select("doc_id")
    many = text_segments(marked.where(F.octet_length("text") > segment), segment)
    rows = cut_lineage(fragment_rows(one, a_path, b_path).unionByName(fragment_rows(many, a_path, b_path)))

    whole = rows.where(F.col("parts") == 1)
    split = rows.where(F.col("parts") > 1)
    split = split.join(split.where(~F.col("ok")).select("rid").distinct(), "rid", "left_anti")
    closing = cut_lineage(closing_groups(split))
    place = F.array(F.col("code").cast("int")).alias("links")
    codes = docs.sparkSession.createDataFrame(pd.DataFrame({"link_a": both.codes >> 32, "link_b": both.codes & 0xFFFFFFFF, "code": np.arange(len(both.codes))}))
    closing_links = closing.join(F.broadcast(codes), ["link_a", "link_b"]).select("rid", place)
    inner_links = split.select("rid", "links")
    counts = link_counts(whole.select("links").unionByName(inner_links.select("links")).unionByName(closing_links.select("links")), len(both.codes))
    b_of = both.codes & 0xFFFFFFFF
    highest = np.zeros(len(both.b_bytes), np.int64)
    np.maximum.at(highest, b_of, counts)
    best = counts == highest[b_of]

    done = with_counts(whole, counts, best, ["doc_id", "n_a", "n_b", "n_groups", "sha256"])
    sums = with_counts(inner_links.unionByName(closing_links), counts, best, ["rid"])
    sums = sums.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    sizes = split.groupBy("rid", "doc_id").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    inner = split.where(F.col("groups").isNotNull()).select("rid", (2 * F.col("no").cast("long") + 1).alias("place"), "groups")
    parts = inner.unionByName(closing.select("rid", (2 * F.col("at").cast("long")).alias("place"), "groups"))
    joined_up = sizes.join(sums, "rid").join(ordered_sha256(parts, ["rid"], "place", "groups", ";"), "rid")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha256"]
    joined_up = joined_up.withColumn("n_groups", F.col("n_links")).select(*columns)

    broken = rows.where((F.col("parts") > 1) & ~F.col("ok")).select("rid", "doc_id").distinct().select("doc_id")
    zero = none.unionByName(broken)
    for c in columns[1:-1]:
        zero = zero.withColumn(c, F.lit(0).cast("long"))
    out = done.select(*columns).unionByName(joined_up).unionByName(zero.withColumn("sha256", F.lit("")))
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("sha256", "groups_sha256")
