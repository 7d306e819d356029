"""Rows of a table told apart where their ids are not unique, and what Python workers hold between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.session import bounded, cut

#: Rows that may be broadcast (ids and hashes, some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Rows of a batch that are looked at together.
SLICE = 200


def small(df: DataFrame) -> DataFrame:
    """df, which has been cut, marked for a broadcast if it has few rows of bounded width."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, nulls: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `__t` long and `__copy` boolean: (id, __t) tells rows of an id with different texts apart.

    __t is 0 where an id occurs once, else a hash of the text. Of rows with the same id and text all but one are copies.
    Null ids are taken for different ones (0, not a copy) unless `nulls`, where they are one id. Only ids are read where none
    repeats; rows of repeated ids are written once, so that every later look at them sees the same row as the first.
    """
    ids = bounded(docs).select(F.col(id_col).alias("__kid"))
    if not nulls:
        ids = ids.where("__kid is not null")
    ids = cut(ids.groupBy("__kid").agg(F.count("*").alias("__n")).where("__n > 1").select("__kid"))
    if ids.isEmpty():
        return docs.withColumns({"__t": F.lit(0).cast("long"), "__copy": F.lit(False)})
    same = F.col(id_col).eqNullSafe(F.col("__kid"))
    once = docs.join(small(ids), same, "left_anti").withColumns({"__t": F.lit(0).cast("long"), "__copy": F.lit(False)})
    some = docs.join(small(ids), same, "left_semi")
    some = cut(some.withColumns({"__t": F.xxhash64(F.col(text_col)), "__row": F.monotonically_increasing_id()}))
    first = cut(some.groupBy(F.col(id_col).alias("__kid"), F.col("__t").alias("__u")).agg(F.min("__row").alias("__first")))
    marked = some.join(small(first), same & (F.col("__t") == F.col("__u")))
    return once.unionByName(marked.withColumn("__copy", F.col("__row") != F.col("__first")).drop("__row", "__kid", "__u", "__first"))


def wrapped(docs: DataFrame, *apart: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as (row, id long, text string): row holds all columns but those `apart`, so that no name of theirs meets another's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in apart]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task needn't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sliced(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], size: int = SLICE) -> Callable:
    """run over slices of each batch, for mapInArrow(); memory is given back after each batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    yield from run(b.slice(at, size))
                del b
                release()
        finally:
            release()

    return over
