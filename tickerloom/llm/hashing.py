"""Rolling hashes over bytes and words in numpy, used inside tasks.

All hashes are 64-bit polynomials with an odd base, so that a span's hash comes from
two prefix sums and the base's inverse, and are mixed at the end.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: the space characters that end a word
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finish a 64-bit value so that all bits depend on all bits (public splitmix finaliser)."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers = [_geometric(_BASE, 1 << 12), _geometric(_INVERSE, 1 << 12)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = [_geometric(_BASE, size), _geometric(_INVERSE, size)]
    return _powers[0], _powers[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base; one longer than the input."""
    n = len(values)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * powers(n + 1)[0][:n], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each span [start, end) of the values behind the sums."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64), salt)


def window_hashes(values: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(values)
    return mix((sums[n:] - sums[:m]) * powers(m)[1][:m], salt)


def byte_values(data: bytes) -> np.ndarray:
    return _BYTE_VALUE[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that are no space)."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of the text, in order."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, U64)
    return span_hashes(prefix_sums(byte_values(data)), starts, ends)


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash of every window of ``width`` hashes, the leftmost of equals.

    The choice depends on the window's content alone, so equal windows choose equal places.
    """
    n = len(hashes)
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    rows = -(-n // width)
    key = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    key[:n] = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    grid = key.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & U64(0xFFFFFFFF)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places that lie in a window of ``width`` beginning at one of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
