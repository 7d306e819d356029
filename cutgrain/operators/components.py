"""Connected components by alternating large-star / small-star steps.

Each step is one aggregation by vertex and one equi-join; both tolerate hub vertices, since the
aggregation combines on the map side and the join can be split by adaptive execution. The number of
steps grows with the logarithm of the vertex count, and each step's edges are checkpointed. Steps end
early where the edges that are left have been counted to be few: one task joins these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.session import cut, narrow


#: Edges that one task joins, 16 bytes each.
FEW = 500_000


def _joined(edges: DataFrame) -> DataFrame:
    """A few edges (u, v) -> (u, smallest reachable v), in one task: roots are lowered and shortened for all edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        ids, place = np.unique(np.concatenate([*(u for u, _ in got), *(v for _, v in got)]), return_inverse=True)
        a, b = np.split(place, 2)
        up = np.arange(len(ids))
        while len(a):
            low = np.minimum(up[a], up[b])
            np.minimum.at(up, up[a], low)
            np.minimum.at(up, up[b], low)
            while (up[up] != up).any():
                up = up[up]
            apart = up[a] != up[b]
            a, b = a[apart], b[apart]
        moved = up != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[up[moved]])], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_steps: int = 50, few: int = FEW) -> DataFrame:
    """edges: an undirected edge list of longs -> (id, component): the smallest reachable id.

    Only vertices that have an edge to another vertex are returned. Null ends and self loops are ignored;
    repeated edges count once; an empty edge list gives an empty result.
    """
    with narrow(edges.sparkSession):
        now = _settled(edges, src, dst, max_steps, few)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _settled(edges: DataFrame, src: str, dst: str, max_steps: int, few: int) -> DataFrame:
    now = cut(edges.where(f"{src} is not null and {dst} is not null and {src} != {dst}").select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    mark = None
    for _ in range(max_steps):
        if now.limit(few + 1).count() <= few:
            return cut(_joined(now))
        now = cut(_small_star(_large_star(now)))
        # order-free fingerprint of the edge set: equal before and after means every vertex points at its root
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(got) == mark or got[0] == 0:
            return now
        mark = tuple(got)
    raise RuntimeError("connected components did not settle")
