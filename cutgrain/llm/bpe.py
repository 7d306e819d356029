"""Byte-level BPE by a hierarchical-bitmap rank queue.

Many pre-tokens are merged together: their bytes stand in one array, with a border after each, as a linked list of parts.
Every adjacent pair that the vocabulary knows waits in the bucket of its rank, which holds its position in the list; a
bitmap over the ranks, with two summary levels above it, gives the lowest non-empty rank by three find-first-set steps.
A bucket's pairs are merged at once, entries whose parts have since been merged are skipped, and the pairs that come to
be are dealt to their buckets. Work grows with the number of merges, so one very long pre-token costs no more a byte
than many short ones.

Texts are cut into words at single spaces, then into pre-tokens by the vocabulary's pattern; results are kept by
word and by pre-token in bounded memories.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.rows import sliced
from cutgrain.llm.words import Words, chunks
from cutgrain.session import bounded

#: Stands for a border between pre-tokens; no pair with it is known.
_BORDER = (1 << 24) - 1


class RankQueue:
    """Buckets by rank, under three levels of 64-bit words; a summary bit is written only when the word below it changes."""

    __slots__ = ("bits", "buckets", "mid", "top")

    def __init__(self, ranks: int) -> None:
        self.bits = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        i = rank >> 6
        if not self.bits[i]:
            if not self.mid[i >> 6]:
                self.top |= 1 << (i >> 6)
            self.mid[i >> 6] |= 1 << (i & 63)
        self.bits[i] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, list[np.ndarray]]:
        """The lowest rank, found by three find-first-set steps, and its bucket; the queue isn't empty."""
        j = (self.top & -self.top).bit_length() - 1
        w = self.mid[j]
        i = j << 6 | (w & -w).bit_length() - 1
        w = self.bits[i]
        rank = i << 6 | (w & -w).bit_length() - 1
        self.bits[i] = w & (w - 1)
        if not self.bits[i]:
            self.mid[j] &= self.mid[j] - 1
            if not self.mid[j]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position to the bucket of its rank; a bucket's are ascending where `positions` are."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edge = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])).tolist()
        for lo, hi, r in zip(edge, [*edge[1:], len(ranks)], ranks[edge].tolist(), strict=True):
            self.push(r, positions[lo:hi])


class Merger:
    """Merges of adjacent parts by rank; a part is the number of a token, and a merge makes the token of its rank."""

    def __init__(self, letters: np.ndarray, pairs: dict[int, int], whole: dict[bytes, int]) -> None:
        """letters: tokens of the 256 bytes; pairs: first << 24 | second -> rank; whole: pre-tokens that are tokens as they are."""
        self.letters, self.whole = letters, whole
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where parts don't merge."""
        key = a << 24 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pre-tokens, one after the other, and how many each has."""
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        found = list(map(self.whole.get, pieces))
        ids, size, certain = self._merge([b"" if r is not None else p for p, r in zip(pieces, found, strict=True)])
        alone = {i: np.array([r]) for i, r in enumerate(found) if r is not None}
        alone |= {int(i): self._merge([pieces[i]], one_by_one=True)[0] for i in np.flatnonzero(~certain)}
        if alone:
            ends, at, parts = np.cumsum(size), 0, []
            for i in sorted(alone):
                parts += [ids[at : ends[i] - size[i]], alone[i]]
                at = ends[i]
                size[i] = len(alone[i])
            ids = np.concatenate([*parts, ids[at:]])
        return ids, size

    def _merge(self, pieces: list[bytes], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of pieces, how many each has, and whether they are certain.

        All pairs of the lowest rank are merged at once. Where that makes a pair of a lower rank still, the order within that
        piece may matter, and it isn't certain; one_by_one merges the leftmost pair of a rank alone.
        """
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        border = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        n = len(data)
        tok = self.letters[data]
        tok[border] = _BORDER
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        pair = np.append(self.rank_of(tok[:-1], tok[1:]), -1)  # rank of the pair whose first part starts here
        queue = RankQueue(int(self.ranks.max(initial=0)))
        at = np.flatnonzero(pair >= 0)
        queue.push_all(pair[at], at)
        odd: list[np.ndarray] = []
        while queue.top:
            r, got = queue.pop()
            a = got[0] if len(got) == 1 else np.concatenate(got)
            a = a[pair[a] == r]  # the others are stale: one of their parts has been merged
            if not len(a):
                continue
            if len(a) > 1:
                a = np.unique(a)
                if one_by_one:
                    queue.push(r, a[1:])
                    a = a[:1]
            m = after[a]
            if len(a) > 1 and (over := a[1:] == m[:-1]).any():  # a run of pairs that share parts: every other one
                first = np.flatnonzero(np.concatenate([[True], ~over]))
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                a = a[rank % 2 == 0]
                m = after[a]
            z = after[m]
            tok[a], after[a], before[z], alive[m], pair[m] = r, z, a, False, -1
            p = before[a]
            right, left = self.rank_of(tok[a], tok[z]), self.rank_of(tok[p], tok[a])
            pair[p], pair[a] = left, right
            at, new = np.concatenate([p, a]), np.concatenate([left, right])
            at, new = at[new >= 0], new[new >= 0]
            if len(at):
                if (low := new < r).any():
                    odd.append(at[low])
                queue.push_all(new, at)
        certain = np.ones(len(pieces), bool)
        if odd and not one_by_one:
            certain[np.searchsorted(border, np.concatenate(odd))] = False
        size = np.diff(np.cumsum(alive)[border], prepend=0) - 1
        alive[border] = False
        return tok[alive], size, certain


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranks, pairs = self.ranks, {}
        for whole, r in ranks.items():  # every way of putting a token together from two
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = r
        self.merge = Merger(np.array([ranks[bytes((i,))] for i in range(256)], np.int64), pairs, ranks)
        self.words = Words(pattern, lambda pretokens: self.merge([p.encode("utf-8", "replace") for p in pretokens]))
        self.parts = {v: k for k, v in ranks.items()}
        self.shown = {v: str(v) for v in self.parts}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        return self.words.of(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))

    def in_decimal(self, ids: list[int]) -> str:
        """ids joined by spaces."""
        return " ".join(map(self.shown.__getitem__, ids))


_made: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _made:
        _made[path, pattern] = Bpe(path, pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, ids array<int>): every row's whole text. A null text counts as empty; empty gives no ids.

    Rows are independent: null or repeated ids are passed through, and other columns are dropped. A very long text is
    held whole in one task, at some ten times its size, whether it is one pre-token or many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for b in batches:
            at = 0
            for some in chunks(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(list(bpe.encode(some)), pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at += len(some)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary). Null ids count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _bpe(ranks_path, pattern).parts
        for b in batches:
            data = [b"".join([parts[i] for i in x or ()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass -> (doc_id, n_tokens, ids_sha256, decoded_sha256), without moving the ids.

    Null and empty texts have no ids and the digests of nothing. Rows are independent: null and repeated ids and repeated rows
    are kept, other columns are dropped, texts of any length are one piece of work each, and no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, a, d = [], [], []
            for ids in bpe.encode(b.column(1).to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(bpe.in_decimal(ids).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        yield from sliced(one, 4000)(batches)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
