"""Runs of windows that chose the same anchor.

Among the short n-grams inside a window, the one of smallest hash (leftmost among
equals) is the window's anchor.  Equal windows choose equal anchors, so all starts of a
window lie in runs with one anchor, and runs can be dealt out and compared by anchor.
"""

from __future__ import annotations

import numpy as np

from .hashing import leftmost_minima, prefix_sums, runs, span_hashes, window_hashes


def anchored_runs(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, start, number of starts, hash of the run's whole content, and number of places of the anchor, run by run.

    A run in which the anchor has several places may repeat a window within itself.
    """
    grams = window_hashes(values, gram, salt=1)
    places = leftmost_minima(grams, window - gram + 1)
    if not len(places):
        none = np.zeros(0, np.int64)
        return grams[:0], none, none, grams[:0], none
    chosen = grams[places]
    a, b = runs(chosen)
    moves = np.r_[0, np.cumsum(places[1:] != places[:-1])]
    return chosen[a], a, b - a, span_hashes(prefix_sums(values), a, b + window - 1, salt=2), moves[b - 1] - moves[a] + 1


def starts_mask(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places that are a start in one of the runs."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + counts, n), -1)
    return np.cumsum(steps[:-1]) > 0
