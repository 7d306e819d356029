"""Packing documents into fixed windows by the online sum-of-squares rule.

A document's ids are cut at multiples of the window; whole windows stand alone and the rest is placed online: of
all fill levels with an open window that it fits into, and a fresh window, it takes the one that leaves the sum
over levels of (number of open windows)^2 smallest. The number of open windows by level is one array.

Ids are computed where the text is read. Only (doc, start, length, checksum) rows are shuffled, to packers that
each hold a bounded share of the documents, so the work spreads with the input and no task sees all of it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.bpe import Merger
from cutgrain.llm.rows import sliced
from cutgrain.llm.words import CHUNK, MEMORY, Words
from cutgrain.session import bounded

#: Documents that one packer places, about.
PER_PACKER = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class SumOfSquares:
    """Open windows of one packer. place() returns the window's number and the offset in it."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.open = np.zeros(window, np.int64)  # the level array: open windows by fill level; level 0 is never open
        self.at: list[list[int]] = [[] for _ in range(window)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The level h with the least change of the sum of squares, 2 (n[h + size] - n[h]) + 2; of equal ones the fullest."""
        w, n = self.window, self.open
        if size >= w:
            self.made += 1
            return self.made - 1, 0
        top = w - size  # a window at this level is filled, and leaves the array: 1 - 2 n[top]
        least, h = 2 * int(n[size]) + 1, 0  # a fresh window
        levels = np.flatnonzero(n[1:top]) + 1
        if len(levels):
            change = n[levels + size] - n[levels]
            i = len(change) - 1 - int(change[::-1].argmin())
            if (c := 2 * int(change[i]) + 2) <= least:
                least, h = c, int(levels[i])
        if n[top] and 1 - 2 * int(n[top]) <= least:
            h = top
        if h:
            n[h] -= 1
            s = self.at[h].pop()
        else:
            s, self.made = self.made, self.made + 1
        if h + size < w:
            n[h + size] += 1
            self.at[h + size].append(s)
        return s, h


class _Ids:
    """Ids of texts as the `tokenizers` library gives them for a byte-level BPE whose merges make ids in rising order.

    Its file's merges go through the rank queue of operator 6; texts that hold strings of special tokens go to the library.
    """

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        if file["model"]["type"] != "BPE" or file["normalizer"] is not None or ranks != sorted(set(ranks)):
            raise ValueError("a byte-level BPE without a normaliser is needed, whose merges make ids in rising order")
        # the letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        letters = np.array([vocab[chr(shown.get(b, b))] for b in range(256)], np.int64)
        merge = Merger(letters, {vocab[a] << 24 | vocab[b]: r for (a, b), r in zip(merges, ranks, strict=True)}, {})
        self.words = Words(pattern, lambda pretokens: merge([p.encode("utf-8", "replace") for p in pretokens]), chunk, memory)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; null texts count as empty."""
        odd = {i for i, t in enumerate(texts) if t and any(x in t for x in self.special)}
        for i, ids in enumerate(self.words.of(["" if i in odd else t for i, t in enumerate(texts)])):
            yield np.array(self.model.encode(texts[i], add_special_tokens=False).ids, np.int32) if i in odd else ids


_made: dict[tuple, _Ids] = {}


def _ids(*kind) -> _Ids:
    if kind not in _made:
        _made[kind] = _Ids(*kind)
    return _made[kind]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, memory: int = MEMORY) -> DataFrame:
    """-> PIECES: whole documents cut at multiples of the window, each piece with its ids' checksum.

    A null or empty text is the end id alone; null and repeated ids are passed through; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer_path, pattern, chunk, memory)

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for doc, own in zip(b.column(0).to_pylist(), ids.of(b.column(1).to_pylist()), strict=True):
                data = np.append(own, end_id).astype("<u4").tobytes()
                n = len(own) + 1
                rows += [(doc, s, min(window, n - s), zlib.crc32(data[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        yield from sliced(one, 4000)(batches)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = 2048, end_id: int = 1, per_packer: int = PER_PACKER, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, memory: int = MEMORY) -> DataFrame:
    """-> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id in exactly one piece.

    A null or empty text is the end id alone. Documents go to packers by a hash of id and text checksum, and each
    packer places them in that order, so a lost executor's packer gives the same windows again. Repeated rows are
    packed once each; null ids are kept; other columns are dropped. A text of any length is cut where it is read, and its
    pieces are placed one by one. A worker looks at `chunk` characters together and keeps the ids of `memory` words at most, for
    some 50 and 100 bytes each. An empty table gives no pieces.
    """
    packers = max(1, -(-docs.count() // per_packer))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, to = None, SumOfSquares(window)
        for b in batches:
            own, size = b.column(0).to_pylist(), b.column("length").to_pylist()
            seq, off = [], []
            for p, n in zip(own, size, strict=True):
                if p != packer:
                    packer, to = p, SumOfSquares(window)
                s, o = to.place(n)
                seq.append(p << 40 | s)
                off.append(o)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(1, 6)] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cut = pieces(docs, tokenizer_path, pattern, window, end_id, id_col, text_col, chunk, memory)
    dealt = cut.select(F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(packers)).alias("packer"), "*")
    spread = dealt.repartition(packers, "packer").sortWithinPartitions("packer", F.xxhash64("doc_id"), "doc_id", "start", "ids_crc32")
    return spread.mapInArrow(place, PIECES + ", sequence_id long, offset long")
