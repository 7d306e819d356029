"""Substring dedup by hashed units: of each repeated line or passage, the earliest occurrence stays.

Units are lines, and pieces of a text's words whose borders the words themselves decide: a border stands where the hash of
GRAM words is the least of some WIDTH neighbouring ones, so a passage has the same borders wherever it stands, and starts
and ends within lines and sentences are found to within WIDTH words. A piece reaches GRAM words beyond its end, so that
neighbouring pieces overlap; a text's start and end are borders too.

Units are normalised (A-Z lower-cased, white space left out) and digested to 96 bits. Digests are grouped globally with the
smallest id that has them; only digests of several ids come back to the documents. A line goes wherever it isn't the
earliest, whatever its length, unless the caller asks for longer ones only; pieces go where a run of such neighbours has
`least_run` words, since short ones recur by chance. Offsets are code points of the original text.

A digest of any number of occurrences is one aggregated row; the join back to the units can be split where one digest
holds many of them. Each document sends a digest once, whatever number of times it has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.rows import keyed, sliced, wrapped
from cutgrain.llm.shingles import isin_sorted, located_words, mix, running
from cutgrain.session import cut

#: Words of the hashes that decide on borders, and how many neighbouring ones a border's is the least of.
GRAM = 4
WIDTH = 12

#: Words that a run of repeated neighbouring pieces has to have to go, where the caller names no other number.
LEAST_RUN = 20

_LINE, _SECOND = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of each `width` consecutive elements."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def borders(gram: np.ndarray) -> np.ndarray:
    """Places of hashes that are the least of some WIDTH neighbours."""
    if len(gram) < WIDTH:
        return np.empty(0, np.int64)
    edge = np.zeros(WIDTH - 1, np.uint64)
    return np.flatnonzero(gram == _sliding(np.concatenate([edge, _sliding(gram, WIDTH, np.minimum), edge]), WIDTH, np.maximum))


class Units:
    """A text's units: digests `h1` and `h2`, first words and the words after the last; pieces come first, then lines."""

    def __init__(self, text: str, least_line: int = 1) -> None:
        data = text.encode("utf-8", "replace")
        h, self.start, self.end = located_words(data)
        self.words = n = len(h)
        a = np.frombuffer(data, np.uint8)
        after = np.append(self.start[1:], len(a))[:n]  # white space goes with the word before it
        feeds = np.flatnonzero(a == 10)
        lines = np.searchsorted(feeds, after) - np.searchsorted(feeds, self.end)
        sums, back = running(h)
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ _SECOND))])
        hashed = lambda s, e: mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        gram = np.arange(max(0, n - GRAM + 1))
        cuts = np.unique(np.concatenate([[0], borders(hashed(gram, gram + GRAM)), [n]]))
        first, last = cuts[:-1], np.minimum(cuts[1:] + GRAM, n)
        self.pieces = len(first)
        line_end = np.flatnonzero(np.append(lines[:-1] > 0, True))[: n or None] + 1 if n else np.empty(0, np.int64)
        line_start = np.append(0, line_end[:-1])[: len(line_end)]
        ok = line_end - line_start >= max(1, least_line)
        self.first, self.last = np.concatenate([first, line_start[ok]]), np.concatenate([last, line_end[ok]])
        self.h1 = hashed(self.first, self.last)
        self.h1[self.pieces :] ^= _LINE
        self.h2 = (other[self.last] - other[self.first]).astype(np.uint32).view(np.int32)
        # a run of pieces takes white space along up to the line's end, a line its end too
        self.to = np.where(lines > 0, self.end, after)
        self.after = after
        if not text.isascii():
            at = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
            self.start, self.end, self.to, self.after = at[self.start], at[self.end], at[self.to], at[self.after]

    def removed(self, late: np.ndarray, least_run: int = LEAST_RUN) -> list[tuple[int, int]]:
        """Offsets of what goes where `late` units aren't the earliest ones, in order and apart from each other."""
        if not late.any():
            return []
        edge = np.flatnonzero(np.diff(late[: self.pieces].astype(np.int8), prepend=0, append=0))
        first, last = self.first[edge[::2]], self.last[edge[1::2] - 1]
        ok = last - first >= least_run
        which = self.pieces + np.flatnonzero(late[self.pieces :])
        start = np.concatenate([self.start[first[ok]], self.start[self.first[which]]])
        end = np.concatenate([self.to[last[ok] - 1], self.after[self.last[which] - 1]])
        out: list[tuple[int, int]] = []
        for i in np.lexsort((end, start)):
            a, z = int(start[i]), int(end[i])
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(z, out[-1][1]))
            else:
                out.append((a, z))
        return out


def _send(b: pa.RecordBatch, least_line: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, text) -> (h1, h2, doc_id, t): each digest of a document once."""
    ids, ts, h1, h2 = [], [], [], []
    for doc, t, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
        u = Units(text, least_line)
        one = np.unique(u.h1, return_index=True)[1]
        h1.append(u.h1[one])
        h2.append(u.h2[one])
        ids.append(np.full(len(one), doc, np.int64))
        ts.append(np.full(len(one), t, np.int64))
    if h1:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h1).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (h2, ids, ts))], names=["h1", "h2", "doc_id", "t"])


def repeated(docs: DataFrame, least_line: int = 1) -> DataFrame:
    """(doc_id, t, text) -> (doc_id, t, late array<long>): digests of a row that another row before it has.

    Before it are rows of smaller ids, and of the same id those of smaller t.
    """
    units, several = (d.mapInArrow(sliced(lambda b: _send(b, least_line)), "h1 long, h2 int, doc_id long, t long") for d in (docs, docs.where("t != 0")))
    # both sides of the joins are dealt anew, so that adaptive execution can split a digest of very many occurrences
    again = cut(units.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"))
    late = units.join(again, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "t", "h1")
    # several: rows of repeated ids
    own = cut(several.groupBy("h1", "h2", "doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("h1", "h2", "doc_id", "lo"))
    if not own.isEmpty():
        late = late.union(several.join(own, ["h1", "h2", "doc_id"]).where("t > lo").select("doc_id", "t", "h1"))
    return late.groupBy("doc_id", "t").agg(F.collect_list("h1").alias("late"))


def dedup(docs: DataFrame, least_line: int = 1, least_run: int = LEAST_RUN, removed_col: str | None = "removed") -> DataFrame:
    """docs without what repeats, and, unless removed_col is None, a column of that name, array<struct<start, end>>: original
    offsets of what went, in order.

    What goes is each line of `least_line` words and more, and each run of pieces of `least_run` words and more, that has an
    earlier occurrence. The earliest is that of the smallest doc_id and offset. Rows that repeat an id come in the order of a
    hash of their texts; of rows with the same id and text one counts as the first. Null texts and texts without words
    lose nothing, nor do rows with a null id, nor count their texts. Other columns stay as they are, whatever their names; an
    input column named removed_col is replaced. A text is held whole in one task, at some hundred times its size. An empty
    table gives no rows.
    """
    names = [c for c in docs.columns if c != removed_col]
    own = keyed(wrapped(docs.select(*[docs[f"`{c}`"] for c in names]), "text"), id_col="id")
    full = own.where("id is not null and text is not null and not __copy").select(F.col("id").alias("doc_id"), F.col("__t").alias("t"), "text")
    late = repeated(full, least_line).select(F.col("doc_id").alias("__doc"), F.col("t").alias("__u"), "late")
    got = own.join(late, (F.col("id") == F.col("__doc")) & (F.col("__t") == F.col("__u")), "left")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, gone = b.column("text").to_pylist(), []
        for i, (text, late, copy) in enumerate(zip(texts, b.column("late").to_pylist(), b.column("copy").to_pylist(), strict=True)):
            out: list[tuple[int, int]] = []
            if text and (late or copy is not None):
                u = Units(text, least_line)
                again = np.ones(len(u.h1), bool)
                if not copy:
                    again[np.unique(u.h1, return_index=True)[1]] = False  # a later occurrence in the same text
                    again |= isin_sorted(u.h1, np.sort(np.array(late or [], np.int64).view(np.uint64)))
                out = u.removed(again, least_run)
            if out:
                texts[i] = "".join([text[a:z] for a, z in zip([0, *[z for _, z in out]], [*[a for a, _ in out], len(text)], strict=True)])
            gone.append([{"start": a, "end": z} for a, z in out])
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(gone, spans)], names=["row", "text", "removed"])

    rows = got.select("row", "text", F.when(F.col("id").isNotNull(), F.col("__copy")).alias("copy"), "late")
    kind = "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{f.dataType.simpleString()}" for f in rows.schema["row"].dataType) + ">"
    done = rows.mapInArrow(sliced(remove), f"row {kind}, text string, removed array<struct<start:int,end:int>>")
    out = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return done.select(*out, *([F.col("removed").alias(removed_col)] if removed_col else []))
