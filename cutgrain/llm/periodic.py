"""Runs of repeated words in texts, and texts without the repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.repeats import runs
from cutgrain.llm.rows import sliced
from cutgrain.llm.words import chunks
from cutgrain.session import bounded

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Bytes of text looked at together; a longer text is a chunk of its own.
CHUNK = 2 << 20
FOUND = "runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def word_runs(texts: list[list[bytes]], power: int, least: int) -> list[np.ndarray]:
    """The runs of each list of words: rows (start, length, period)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(x, len(table)) for t in texts for x in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    # every word of a run is in its text at least `power` times, so runs lie within stretches of such words
    _, own, count = np.unique(doc * max(len(table), 1) + ids, return_inverse=True, return_counts=True)
    often = count[own] >= power
    opens = np.flatnonzero(often & ~np.r_[False, often[:-1] & (doc[1:] == doc[:-1])]) if len(ids) else np.empty(0, np.int64)
    closes = np.flatnonzero(often & ~np.r_[often[1:] & (doc[1:] == doc[:-1]), False]) + 1 if len(ids) else opens
    long = closes - opens >= least
    opens, size = opens[long], (closes - opens)[long]
    at = np.cumsum(size) - size
    places = np.repeat(opens - at, size) + np.arange(size.sum())
    found = runs(np.repeat(np.arange(len(opens)), size) * (len(count) + 1) + own[places], power, least)
    found[:, 0] = places[found[:, 0]]
    whose = doc[found[:, 0]]
    found[:, 0] -= first[whose]
    return np.split(found, np.searchsorted(whose, np.arange(1, len(texts)))) if texts else []


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    if not len(found):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def collapse(docs: DataFrame, power: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, runs, collapsed): every run of a text's words, by start and period, and the text without what repeats.

    Words are runs of bytes other than [\\x20\\x09-\\x0D], numbered from 0. A run is a stretch with a smallest period that no
    neighbour extends, of max(least, power * period) words and more. Each run's words after its first period go; what stays is
    joined by single spaces. Texts are looked at in the task that reads them, many at once, and nothing is shuffled; a text of
    any length is one piece of work, with some 200 bytes a word. Null and empty texts have no runs and collapse to "". Rows
    are independent: null and repeated ids and repeated rows are kept each; other columns are dropped; no rows give none.
    """

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, parts, texts = [0], [np.empty((0, 3), np.int64)], []
        for some in chunks(b.column(1).to_pylist(), CHUNK):
            split = [(t or b"").split() for t in some]
            for words, found in zip(split, word_runs(split, power, least), strict=True):
                offsets.append(offsets[-1] + len(found))
                parts.append(found)
                texts.append(_collapsed(words, found))
        rows = np.concatenate(parts)
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], fields=list(RUN))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields), pa.array(texts, pa.binary())], names=[id_col, "runs", "collapsed"])

    own = bounded(docs).select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = own.schema[id_col].dataType.simpleString()
    return own.mapInArrow(sliced(one), f"`{id_col}` {kind}, {FOUND}").withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """collapse()'s rows -> (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): of the longest
    run, of equal ones the first, of these the one with the smallest period; nulls where there is none."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    got = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select(
        id_col,
        "n_runs",
        (-F.col("top.back")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.short")).alias("period"),
        F.expr("1000 * top.length div -top.short").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
