"""Texts cut into words and pre-tokens, whose ids are computed for many at once and kept in bounded memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import regex

from cutgrain.llm.shingles import isin_sorted, span_hashes

#: Words that are kept from one chunk of texts to the next.
MEMORY = 1_000_000
#: Characters of text looked at together; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Longer keys are not kept in a Memory.
LONGEST = 64

#: Characters after which a word of letters ends as a pre-token of its own, and which are one themselves.
_ENDS = frozenset(".,;:!?")

#: White space on which words and pre-tokens might be cut differently: two spaces, or three characters and more.
_UNSAFE = re.compile(r"\s\s\s|  ")

#: Without such a character and without two spaces, it can only be one of these.
_RARE = re.compile(r"[^\S \n]")
_THREE = ("\n\n\n", "\n\n ", " \n\n", "\n \n", " \n ")


def unsafe(text: str) -> bool:
    """Whether single spaces may not be taken as borders of pre-tokens."""
    if "  " in text:
        return True
    if _RARE.search(text) is None:
        return "\n" in text and any(x in text for x in _THREE)
    return _UNSAFE.search(text) is not None


def chunks(texts: list, size: int = CHUNK) -> Iterator[list]:
    """Consecutive texts of about `size` characters together."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t or "") > size:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t or "")
    if some:
        yield some


class Memory(dict):
    """A dict that computes what it lacks; when full, the older half is forgotten."""

    def __init__(self, make: Callable, size: int = 200_000, longest: int = LONGEST) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, x):
        got = self.old.get(x)
        if got is None:
            got = self.make(x)
        if len(x) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[x] = got
        return got


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """The ids of texts, by pre-token.

    `values` gives many distinct pre-tokens' ids at once: all of them in one array, and how many each has. In texts where
    single spaces are borders of pre-tokens, whole words are looked up by 64-bit hashes of their bytes (two of a million
    words share one with a probability of 3e-8); what was made of them is kept, and forgotten when it is too much.
    """

    def __init__(self, pattern: str, values: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK, memory: int = MEMORY) -> None:
        self.pattern = regex.compile(pattern)
        self.values = values
        self.chunk, self.memory = chunk, memory
        self._forget()

    def _forget(self) -> None:
        #: sorted hashes of known words; where the ids of each begin in `ids`, and how many there are
        self.keys, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        pieces: dict[str, int] = {}
        made: list[int] = []
        parts: list[int] = []
        put, findall = pieces.setdefault, self.pattern.findall
        for w in words:
            x = w[1:] if w[0] == " " else w
            if x.isalpha():  # letters, and a space before them, are one pre-token
                made.append(put(w, len(pieces)))
                parts.append(1)
            elif x[-1:] in _ENDS and x[:-1].isalpha():
                made.append(put(w[:-1], len(pieces)))
                made.append(put(w[-1], len(pieces)))
                parts.append(2)
            else:
                c = findall(w)
                made += [put(p, len(pieces)) for p in c]
                parts.append(len(c))
        ids, size = self.values(list(pieces))
        place = np.array(made, np.int64)
        start = (np.cumsum(size) - size)[place]
        own = np.add.reduceat(size[place], np.cumsum(parts) - parts) if parts else np.empty(0, np.int64)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys)
        self.keys = all_keys[order]
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(own) - own])[order]
        self.size = np.concatenate([self.size, own])[order]
        self.ids = np.concatenate([self.ids, gather(ids, start, size[place]).astype(np.int32)])

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null texts count as empty."""
        for some in chunks(texts, self.chunk):
            plain = [i for i, t in enumerate(some) if t and not unsafe(t)]
            out = dict(zip(plain, self._plain([some[i].encode("utf-8", "replace") for i in plain]), strict=True))
            rest = [i for i, t in enumerate(some) if i not in out]
            out |= dict(zip(rest, self._cut([some[i] or "" for i in rest]), strict=True))
            for i in range(len(some)):
                yield out.pop(i)

    def _cut(self, texts: list[str]) -> Iterator[np.ndarray]:
        """By the pattern over whole texts."""
        pieces: dict[str, int] = {}
        places = [np.array([pieces.setdefault(p, len(pieces)) for p in self.pattern.findall(t)], np.int64) for t in texts]
        ids, size = self.values(list(pieces))
        start = np.cumsum(size) - size
        for p in places:
            yield gather(ids, start[p], size[p]).astype(np.int32)

    def _plain(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """By words, a space and what follows up to the next one."""
        if not texts:
            return
        data = b"".join(texts)
        a = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(a) + 1, bool)
        first[:-1] = a == 32
        first[0] = first[ends] = True
        at = np.flatnonzero(first)
        keys = span_hashes(a, at)
        kinds, one, which = np.unique(keys, return_index=True, return_inverse=True)
        lacks = ~isin_sorted(kinds, self.keys)
        begin, end = at[:-1][one[lacks]].tolist(), at[1:][one[lacks]].tolist()
        if len(self.keys) + len(begin) > self.memory or len(self.ids) > 16 * self.memory:  # what this chunk needs and is known goes along
            self._forget()
            begin, end, lacks = at[:-1][one].tolist(), at[1:][one].tolist(), slice(None)
        if begin:
            self._learn(kinds[lacks], [data[lo:hi].decode() for lo, hi in zip(begin, end, strict=True)])
        place = np.searchsorted(self.keys, kinds)[which]
        size = self.size[place]
        ids = gather(self.ids, self.start[place], size)
        border = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, np.concatenate([[0], ends]))].tolist()
        for lo, hi in zip(border, border[1:], strict=False):
            yield ids[lo:hi]
