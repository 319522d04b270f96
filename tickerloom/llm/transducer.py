"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A tokenisation is the one the merges give if and only if every two neighbouring tokens
stay apart when their joined bytes are merged alone.  So each prefix of a piece has one
last token, and a machine that reads bytes only has to know, for the recent places
where a token may still begin, which token comes last before them.  That knowledge is
the state: the bytes since the oldest such place, the open places and their last tokens.
States and their transitions are made when first met.  Each transition gives the length
of the last token; tokens are emitted where all open ways agree on them, which the
longest token of the vocabulary bounds, or at the end.

Defined cases: a null text is encoded as an empty one (no ids); texts of any length are
read whole; equal rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .chunks import Cache, pieces
from .inputs import id_and_text, map_frames
from .merges import load_ranks, merge_bytes


class Transducer:
    """Encoder of single pieces; ``most_states`` bounds the states that are kept."""

    #: bytes between two emissions within a piece
    STRIDE = 256

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000) -> None:
        self.ranks = ranks
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        self.most_states = most_states
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: (bytes since the oldest open place, open places, the last token before each)
        self.states: list[tuple[bytes, tuple[int, ...], tuple[bytes, ...]]] = []
        self.numbers: dict[tuple, int] = {}
        # a transition: the next state and the length of the last token after the byte
        self.steps: list[dict[int, tuple[int, int]]] = []
        self._number((b"", (0,), (b"",)))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return n

    def _fits(self, before: bytes, token: bytes) -> bool:
        """Can the token follow the one before it (or stand first)?"""
        if token not in self.ranks:
            return False
        whole = self.whole.get(token)
        if whole is None:
            whole = self.whole[token] = len(merge_bytes(token, self.ranks)) == 1
        if not whole or not before:
            return whole
        known = self.apart.get((before, token))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[before, token] = merge_bytes(before + token, self.ranks) == [before, token]
        return known

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        """Read one byte: the next state and the length of the last token there."""
        text, places, lasts = self.states[number]
        text += bytes((byte,))
        n, last = len(text), None
        open_, before = [], []
        for place, way in zip(places, lasts):  # the longest token first
            rest = text[place:]
            if last is None and self._fits(way, rest):
                last = rest
            if rest in self.starts:
                open_.append(place)
                before.append(way)
        if last is None:
            raise ValueError("the vocabulary lacks a byte of the text")
        open_.append(n)
        before.append(last)
        first = open_[0]
        return self._number((text[first:], tuple([p - first for p in open_]), tuple(before))), len(last)

    def _settled(self, sizes: list[int], at: int) -> int:
        """The place up to which all open ways have the same tokens."""
        text, places, _ = self.states[at]
        ways = {len(sizes) - len(text) + p for p in places}
        while len(ways) > 1:
            place = max(ways)
            ways.remove(place)
            ways.add(place - sizes[place - 1])
        return ways.pop()

    @staticmethod
    def _tokens(piece: bytes, sizes: list[int], start: int, end: int) -> list[bytes]:
        out = []
        while end > start:
            size = sizes[end - 1]
            out.append(piece[end - size : end])
            end -= size
        return out[::-1]

    def stream(self, piece: bytes) -> Iterator[list[bytes]]:
        """Tokens of a piece, as soon as no later byte can change them."""
        if piece in self.ranks:
            yield [piece]
            return
        if len(self.states) > self.most_states:
            self._clear()
        sizes: list[int] = []
        at = done = 0
        steps = self.steps
        for begin in range(0, len(piece), self.STRIDE):
            for byte in piece[begin : begin + self.STRIDE]:
                try:
                    at, size = steps[at][byte]
                except KeyError:
                    steps[at][byte] = step = self._step(at, byte)
                    at, size = step
                sizes.append(size)
            settled = self._settled(sizes, at) if len(sizes) < len(piece) else len(piece)
            if settled > done:
                yield self._tokens(piece, sizes, done, settled)
                done = settled

    def encode(self, piece: bytes) -> list[bytes]:
        """Tokens of a piece, as the merges give them."""
        if piece in self.ranks:
            return [piece]
        if len(piece) > self.STRIDE:
            return [token for part in self.stream(piece) for token in part]
        if len(self.states) > self.most_states:
            self._clear()
        at, steps, sizes = 0, self.steps, []
        for byte in piece:
            step = steps[at].get(byte)
            if step is None:
                steps[at][byte] = step = self._step(at, byte)
            at, size = step
            sizes.append(size)
        return self._tokens(piece, sizes, 0, len(piece))


class TextStream:
    """Incremental UTF-8 decoding: bytes of an unfinished character wait for the next call."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(4, cut) + 1):  # the last lead byte and what it asks for
            lead = data[cut - back]
            if lead & 0xC0 == 0x80:
                continue
            needs = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if needs > back:
                cut -= back
            break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        self.ranks = load_ranks(rank_path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.machine = Transducer(self.ranks)
        # White_Space as the Unicode property, whatever a library's own \s holds
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
        inside = inside.replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
        self.split = regex.compile(inside).findall
        self.inner = Cache(self._piece)
        self.first = Cache(self._ids)
        self.rest = Cache(self._rest)
        # a word of letters and one mark split between the two
        self.marked = regex.compile(r"(\p{L}+)([.,;:!?])").fullmatch
        self._long = struct.Struct("<I").pack

    def _rest(self, text: str) -> bytes:
        if match := self.marked(text):
            return self.rest[match[1]] + self.inner[match[2]]
        return self._ids(" " + text)

    def _piece(self, piece: str) -> bytes:
        get, pack = self.ranks.__getitem__, self._long
        return b"".join([pack(get(t)) for t in self.machine.encode(piece.encode())])

    def _ids(self, text: str) -> bytes:
        return b"".join([self.inner[p] for p in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        head, *tail = pieces(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))

    def decode(self, ids: bytes, step: int = 65_536):
        """Parts of the text, decoded while the ids come in."""
        stream, get = TextStream(), self.tokens.__getitem__
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), step):
            yield stream.feed(b"".join(map(get, numbers[at : at + step].tolist())))
        yield stream.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and process."""
    key = (rank_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_path, pattern)
        gc.freeze()  # tables and caches hold no cycles; looking through them again and again costs much
        gc.set_threshold(200_000, 50, 1000)
    return _codecs[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every row."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_path, pattern)
        ids = [c.encode(t) for t in frame["text"]]
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    return map_frames(id_and_text(docs, id_col, text_col), each, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and text of every row of ids; null ids give an empty text."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_path, pattern)
        frame["text"] = ["".join(c.decode(x or b"")) for x in frame["ids"]]
        return frame

    return map_frames(encoded.select("doc_id", "n_tokens", "ids"), each, "doc_id long, n_tokens long, ids binary, text string")


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every row, made where the ids are."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_path, pattern)
        rows = []
        for text in frame["text"]:
            ids = c.encode(text)
            back = hashlib.sha256()
            for part in c.decode(ids):
                back.update(part.encode())
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        return out

    return map_frames(id_and_text(docs), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
