"""Hashed words and word shingles of texts, vectorised over byte buffers.

Words are runs of bytes other than white space [\\x20\\x09-\\x0D], A-Z lower-cased. A word's hash is a polynomial of
its bytes modulo 2^64, taken from running sums, so that no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; longer texts are cut between words.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK + 1), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= 4 * CHUNK:
            _powers[name] = got
    return got[:n]


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[a].view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[a] * _power("on", _BASE, len(a)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("back", _BACK, len(a))[start] + (end - start).astype(np.uint64)), start, end


def running(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial over hashes, and the factors that take a range of them to its start."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("on", _BASE, len(h)), out=sums[1:])
    return sums, _power("back", _BACK, len(h) + 1)


def span_hashes(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the bytes a[at[i] : at[i + 1]], taken over about CHUNK bytes at once."""
    out, lo = [np.empty(0, np.uint64)], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        part = a[at[lo] : at[hi]]
        cuts = at[lo : hi + 1] - at[lo]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * _power("on", _BASE, len(part)), out=sums[1:])
        out.append(mix((sums[cuts[1:]] - sums[cuts[:-1]]) * _power("back", _BACK, len(part) + 1)[cuts[:-1]] + np.diff(cuts).astype(np.uint64)))
        lo = hi
    return np.concatenate(out)


def isin_sorted(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def located_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, where they start and end (bytes)."""
    data = data.lower()
    if len(data) <= CHUNK:
        return _hash_chunk(data)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        h, start, end = _hash_chunk(data[at:to])
        out.append((h, start + at, end + at))
        at = to
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def word_hashes(text: str) -> np.ndarray:
    return located_words(text.encode("utf-8", "replace"))[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of fewer words, the whole sequence's; of none, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    got = words[: n - k + 1]
    for j in range(1, k):
        got = mix(got * np.uint64(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j])
    return np.unique(got)
