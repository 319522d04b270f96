"""Token counts by merging pairs on a linked list with a heap.

The symbols of a piece are its characters.  A heap holds the neighbouring pairs that the
vocabulary knows as one entry, best score first and leftmost among equals; popping a
pair joins it in the linked list and offers the pairs with its new neighbours.  The
count is the number of initial symbols less the merges; a character that stays alone
and that the vocabulary lacks counts as its bytes.  No ids are made.

Pieces are cut before each word mark that follows another character, where no entry of
the vocabulary reaches across (checked when it is loaded; else texts stay whole).

Defined cases: a null or empty text has no bytes and no tokens; texts of any length are
read whole; equal rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import heapq

import pandas as pd

from pyspark.sql import DataFrame

from .chunks import Cache
from .inputs import id_and_text, map_frames

MARK = "\u2581"


class PieceCounter:
    """Counts the tokens of a text for a merging vocabulary with byte fallback."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merging vocabulary with byte fallback is asked for")
        if spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("texts have to be taken as they are")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("entries of the user and unused entries are not merged by score alone")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.scores)
        #: characters that stand side by side within some entry; between others a piece may be cut
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.counts = Cache(self._piece)

    def _piece(self, text: str) -> int:
        """Count of a piece, cut between all neighbours that no entry joins; a part has no such cut, so this calls itself once."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        if not cuts:
            return self.merge(text)
        return sum(self.counts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)]))

    def merge(self, text: str) -> int:
        """Tokens of one piece, white space already written as the mark."""
        scores = self.scores
        if text in scores and len(text) == 1:
            return 1
        n = len(text)
        get, push, pop = scores.get, heapq.heappush, heapq.heappop
        symbols: list[str | None] = list(text)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            joined = text[i : i + 2]
            score = get(joined)
            if score is not None:
                heap.append((-score, i, i + 1, joined))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, right, joined = pop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(joined):
                continue  # one side has been joined since
            symbols[left], symbols[right] = joined, None
            merges += 1
            follows = after[left] = after[right]
            leads = before[left]
            if follows >= 0:
                before[follows] = left
                longer = joined + symbols[follows]
                score = get(longer)
                if score is not None:
                    push(heap, (-score, left, follows, longer))
            if leads >= 0:
                longer = symbols[leads] + joined
                score = get(longer)
                if score is not None:
                    push(heap, (-score, leads, left, longer))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in scores)
        return n - merges + unknown

    def count(self, text: str) -> int:
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        if not self.cut:
            return self.counts[text]
        head, *parts = text.split(MARK)
        total, marks = self.counts[head] if head else 0, 0
        for part in parts:  # a run of marks stays with the word after it
            marks += 1
            if part:
                total += self.counts[MARK * marks + part]
                marks = 0
        return total + (self.counts[MARK * marks] if marks else 0)


_counters: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        c = counter(model_path)
        tokens = [c.count(t) for t in frame["text"]]
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "n_bytes": [len(t.encode()) for t in frame["text"]],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }
        )

    return map_frames(id_and_text(docs, id_col, text_col), each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
