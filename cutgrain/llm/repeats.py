"""Maximal repetitions (runs) of integer sequences, many sequences at once.

Suffixes are sorted by doubling; the sorted order and the common prefixes of neighbours give each position's longest previous
factor and where it stood. These factors cut a sequence into blocks. A run that touches a block's border is found there by
extending both ways under each possible period; a run strictly within a block stood within the block's source as well, and is
copied from there, in order of starts. With `power` periods required (2: all runs), periods at a border are shorter by that much.

Sequences are concatenated with disjoint alphabets, so nothing extends from one into the next.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def ranks(w: np.ndarray) -> list[np.ndarray]:
    """Names of the substrings of 1, 2, 4, ... symbols from each position, equal where these are; the last are all different,
    and the places in suffix order. Only what is still tied is sorted again."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    head = np.r_[True, np.diff(w[order]) != 0] if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    out, h = [rank], 1
    tied = order[~(head & np.r_[head[1:], True])] if n else order
    while len(tied):
        rank = rank.copy()
        at = tied + h
        after = np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        o = np.argsort(rank[tied] * (n + 1) + after, kind="stable")
        tied, after = tied[o], after[o]
        group = rank[tied]
        old = np.r_[True, np.diff(group) != 0]
        new = old | np.r_[True, np.diff(after) != 0]
        place = np.arange(len(tied))
        since = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = group + since - np.maximum.accumulate(np.where(old, place, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        out.append(rank)
        h *= 2
    return out


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal; i and j differ, and may be the sequence's end."""
    n = len(levels[0])
    got = np.zeros(len(i), np.int64)
    live = np.flatnonzero((i < n) & (j < n))
    a, b = i[live], j[live]
    for k in range(len(levels) - 2, -1, -1):
        if not len(live):
            break
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        got[live[same]] += 1 << k
        a, b = a + (same << k), b + (same << k)
    return got


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest factor from it that also begins earlier, and where it does."""
    n = len(levels[0])
    place = levels[-1]
    sa = np.empty(n, np.int64)
    sa[place] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    if n > 1:
        lcp[1:n] = common(levels, sa[:-1], sa[1:])
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for step in (-1, 1):
        # the nearest entry in suffix order that stands earlier in the sequence, by jumps over those that don't
        to = np.arange(n) + step
        least = lcp[:n].copy() if step < 0 else lcp[1:].copy()
        live = np.arange(n)
        while True:
            live = live[(to[live] >= 0) & (to[live] < n)]
            live = live[sa[to[live]] > sa[live]]
            if not len(live):
                break
            over = to[live]
            # what is jumped over has jumped as far as it had before this round
            far, low = to[over], least[over]
            to[live] = far
            least[live] = np.minimum(least[live], low)
        there = (to >= 0) & (to < n)
        own = np.where(there, least, 0)
        better = own > length[sa]
        length[sa[better]] = own[better]
        source[sa[better]] = sa[to[better]]
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the blocks begin, and the sequence's end."""
    out, i, n, step = [], 0, len(length), np.maximum(length, 1).tolist()
    while i < n:
        out.append(i)
        i += step[i]
    return np.array([*out, n], np.int64)


def _at_borders(w: np.ndarray, levels: list[np.ndarray], border: np.ndarray, power: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of what extends across or up to the blocks' borders, repeats and multiples included."""
    n = len(w)
    size = np.diff(border, append=n)  # the end is a border before an empty block
    before = np.r_[0, size[:-1]]
    spread = lambda b, most: (np.repeat(b, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1)
    found = []
    for side in ("after", "before"):
        if side == "after":  # the border is in the first period, so a period and more follows in the block
            b, q = spread(border, size // (power - 1))
            other = b + q
            ok = other < n
            b, q, other = b[ok], q[ok], other[ok]
            if power > 2:
                ok = w[b] == w[other]
                b, q, other = b[ok], q[ok], other[ok]
        else:  # the border is beyond the first period, so what precedes it repeats
            b, q = spread(border, (before + size) // (power - 1))
            other = b - q
            ok = other > 0
            b, q, other = b[ok], q[ok], other[ok]
            ok = w[b - 1] == w[other - 1]
            b, q, other = b[ok], q[ok], other[ok]
            if power > 2:  # at least two symbols and more extend
                more = (b < n) & (w[np.minimum(b, n - 1)] == w[other]) | (other > 1) & (w[b - 2] == w[np.maximum(other - 2, 0)]) | ((power - 1) * q < 2)
                b, q, other = b[more], q[more], other[more]
        on = common(levels, b, other)
        if side == "after" and power > 2:
            ok = on >= (power - 2) * q
            b, q, other, on = b[ok], q[ok], other[ok], on[ok]
        found.append((b, other, q, on))
    b, other, q, on = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(b):
        return np.empty((0, 3), np.int64)
    back = ranks(w[::-1])
    off = common(back, n - b, n - other)
    start, length = np.minimum(b, other) - off, on + off + q
    ok = length >= np.maximum(power * q, least)
    return np.stack([start[ok], length[ok], q[ok]], 1)


def runs(w: np.ndarray, power: int = 2, least: int = 2) -> np.ndarray:
    """All runs of a sequence: rows (start, length, smallest period), length >= max(least, power * period), by start, then period.

    Needs some 8 bytes a symbol for each doubling up to its longest repeat. The empty sequence has none.
    """
    w = np.asarray(w, np.int64)
    if len(w) < least:
        return np.empty((0, 3), np.int64)
    levels = ranks(w)
    length, source = previous_factors(levels)
    border = blocks(length)
    near = _at_borders(w, levels, border, power, least)
    if not len(near):
        return near
    # of one stretch the smallest period; the others are its multiples
    near = near[np.lexsort((near[:, 2], near[:, 1], near[:, 0]))]
    near = near[np.r_[True, (np.diff(near[:, :2], axis=0) != 0).any(1)]].tolist()
    known, have = [tuple(r) for r in near], {tuple(r) for r in near}
    least = min(r[1] for r in near)
    at = border[:-1]
    far = np.flatnonzero(np.diff(border) >= least + 2)
    for b, size, src in zip(at[far].tolist(), np.diff(border)[far].tolist(), source[at[far]].tolist(), strict=True):
        i = bisect_left(known, (src + 1,))
        while i < len(known) and known[i][0] < src + size:
            s, m, q = known[i]
            if s + m < src + size and (copy := (s + b - src, m, q)) not in have:
                have.add(copy)
                insort(known, copy)  # to the right of i, where a source that overlaps its block looks later
            i += 1
    return np.array(sorted(known, key=lambda r: (r[0], r[2])), np.int64)
