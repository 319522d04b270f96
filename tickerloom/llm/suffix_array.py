"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost
smaller ones (LMS) are sorted through their substrings, and all other suffixes are
induced from them bucket by bucket in linear time.  Where substrings repeat, the string
of their names is sorted in the same way, or by prefix doubling if it has many names.
With few symbols a bucket is handled as arrays: all that its entries induce is dealt to
the buckets at once, and what falls into the same bucket is the next round.
"""

from __future__ import annotations

import numpy as np

#: alphabets up to this size are induced, larger ones (of recursion) sorted by doubling
SMALL = 600


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last (the sentinel) is."""
    step = np.sign(np.diff(s.astype(np.int64)))
    n = len(s)
    # equal neighbours take the type of the next place that differs
    known = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


def _deal(at: np.ndarray, keys: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    # keys of 16 bits are sorted by radix, in linear time
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        waiting[keys[a]].append(at[a:b])


def _induce_arrays(s: np.ndarray, smaller: np.ndarray, symbols: int, lms: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in the order given (sorted within each bucket)."""
    s = s.astype(np.uint16)
    none = np.zeros(0, np.int64)
    first = [none] * symbols  # LMS of each bucket
    heads: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _deal(lms, s[lms], heads)
    for c in range(symbols):
        if heads[c]:
            first[c] = np.concatenate(heads[c])
    large = [none] * symbols
    for c in range(symbols):
        batch = np.concatenate(waiting[c]) if waiting[c] else none
        got = []
        while len(batch):
            got.append(batch)
            left = batch[batch > 0] - 1
            left = left[~smaller[left]]
            keys = s[left]
            batch = left[keys == c]
            out = keys > c
            if out.any():
                _deal(left[out], keys[out], waiting)
        large[c] = np.concatenate(got) if got else none
        if len(first[c]):
            left = first[c][first[c] > 0] - 1
            left = left[~smaller[left]]
            if len(left):
                _deal(left, s[left], waiting)
    waiting = [[] for _ in range(symbols)]
    small = [none] * symbols
    for c in range(symbols - 1, -1, -1):
        batch = np.concatenate(waiting[c]) if waiting[c] else none
        got = []
        while len(batch):
            got.append(batch)
            left = batch[batch > 0] - 1
            left = left[smaller[left]]
            keys = s[left]
            batch = left[keys == c]
            out = keys < c
            if out.any():
                _deal(left[out], keys[out], waiting)
        small[c] = np.concatenate(got)[::-1] if got else none
        if len(large[c]):
            left = large[c][::-1]
            left = left[left > 0] - 1
            left = left[smaller[left]]
            if len(left):
                _deal(left, s[left], waiting)
    small[s[-1]] = np.array([len(s) - 1])  # the sentinel stands alone in its bucket
    return np.concatenate([x for c in range(symbols) for x in (large[c], small[c])])


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    # a rank is the first place of the suffixes that are equal so far
    first = np.r_[True, s[order[1:]] != s[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    live = order[~(first & np.r_[first[1:], True])]
    step = 1
    while len(live):
        # equal so far, so none of them has reached the sentinel
        key = rank[live] * n + rank[live + step]
        by = np.argsort(key)
        live, key = live[by], key[by]
        group = key // n
        head = np.r_[True, group[1:] != group[:-1]]
        at = np.arange(len(live))
        place = group + at - np.maximum.accumulate(np.where(head, at, 0))
        first = np.r_[True, key[1:] != key[:-1]]
        order[place] = live
        rank[live] = np.maximum.accumulate(np.where(first, place, 0))
        live = live[~(first & np.r_[first[1:], True])]
        step *= 2
    return order


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Order of the suffixes of s, whose last symbol is its only 0."""
    if len(s) <= 2:
        return np.arange(len(s))[::-1].copy()
    s = s.astype(np.int64, copy=False)
    if symbols > SMALL:
        return _doubled(s)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        rough = _induce_arrays(s, smaller, symbols, lms)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        # name the substrings: equal neighbours share a name
        length = np.zeros(len(s), np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        open_ = np.flatnonzero(same)
        depth = 0
        while len(open_):
            open_ = open_[length[a[open_]] > depth]
            differs = s[a[open_] + depth] != s[b[open_] + depth]
            same[open_[differs]] = False
            open_ = open_[~differs]
            depth += 1
        names = np.zeros(len(s), np.int64)
        names[order] = np.r_[0, np.cumsum(~same)]
        reduced = names[lms]
        kinds = int(reduced.max()) + 1
        if kinds < len(lms):
            order = lms[suffix_array(reduced, kinds)]
    else:
        order = lms
    return _induce_arrays(s, smaller, symbols, order)


def common_prefixes(data: bytes, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predecessor of every suffix in the order (-1 for the first), and the permuted common prefixes.

    Place i has the length that suffix i shares with its predecessor.  Where the bytes
    before both are equal, it is that of place i - 1 less one; only the others are
    compared, eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    raw = np.frombuffer(data + bytes(16), np.uint8)
    words = np.ndarray((n + 8,), "<u8", raw, 0, (1,))
    i = np.arange(n)
    compare = before < 0
    compare[0] = True
    inner = ~compare
    compare[inner] = (before[inner] == 0) | (raw[i[inner] - 1] != raw[before[inner] - 1])
    value = np.zeros(n, np.int64)
    at = np.flatnonzero(compare & (before >= 0))
    other, length = before[at], np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + length[live], other[live] + length[live]
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        whole = (differ == 0) & (x < n) & (y < n)
        ended = live[~whole]
        d = differ[~whole]
        low = (d & (~d + np.uint64(1))).astype(np.float64)
        length[ended] += np.where(d == 0, 8, (np.log2(np.where(low > 0, low, 1)) // 8).astype(np.int64))
        length[live[whole]] += 8
        live = live[whole]
    value[at] = np.minimum(length, n - np.maximum(at, other))
    last = np.maximum.accumulate(np.where(compare, i, 0))
    return before, np.where(compare, value, value[last] - (i - last))
