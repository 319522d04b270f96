"""Quality rules from repetition coverage.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  Rolling hashes of several
n-gram lengths mark the n-grams that occur twice or more in a text; the rule measures
the share of word characters that lies inside such n-grams, and inside repeated lines.

Defined cases: a null or empty text has no words and fails the base rule; a text of
any length is read whole; equal rows each give a row; an empty table gives no rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .hashing import IS_SPACE, U64, byte_values, covered, prefix_sums, span_hashes, window_hashes, word_bounds
from .inputs import id_and_text, map_frames

#: fixed values: share of word characters inside repeated n-grams above which a text is refused
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: fixed values: shares of lines, and of characters in lines, that repeat an earlier line
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
#: one repeated line is no habit
LEAST_LINES = 2
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ngram_coverage array<double>, line_share double, line_char_share double"
)


def repeated_windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the windows: those that occur twice or more, and those that occurred before."""
    if len(hashes) < 2:
        none = np.zeros(len(hashes), bool)
        return none, none
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    later, any_ = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def measure(text: str) -> tuple:
    """All measures of one text."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    chars = np.r_[0, np.cumsum(((raw & 0xC0) != 0x80) & ~IS_SPACE[raw])]
    word_chars = int(chars[-1])
    lengths = chars[ends] - chars[starts]
    words = span_hashes(prefix_sums(byte_values(data)), starts, ends) if n else np.zeros(0, U64)
    any_, _ = repeated_windows(window_hashes(words, 3))
    repeat_words = int(covered(np.flatnonzero(any_), 3, n).sum()) if n else 0
    seen: set[str] = set()
    lines = dup_lines = line_chars = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    coverage = []
    for size in NGRAM_LIMITS:
        _, later = repeated_windows(window_hashes(words, size))
        inside = covered(np.flatnonzero(later), size, n) if later.any() else None
        coverage.append(float(lengths[inside].sum() / word_chars) if inside is not None else 0.0)
    line_share = dup_lines / lines if lines else 0.0
    char_share = dup_chars / line_chars if line_chars else 0.0
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    fine = (
        all(c <= limit for c, limit in zip(coverage, NGRAM_LIMITS.values()))
        and (dup_lines < LEAST_LINES or (line_share <= LINE_LIMIT and char_share <= LINE_CHAR_LIMIT))
    )
    return n, word_chars, int(_SYMBOL[raw].sum()), dup_lines, repeat_words, failed, fine and not failed, coverage, line_share, char_share


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every text; one row for each input row."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [measure(t) for t in frame["text"]]
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
        return out

    return map_frames(id_and_text(docs, id_col, text_col), each, SCHEMA)
