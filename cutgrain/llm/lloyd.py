"""Centroid clustering: plain Lloyd over integers, whose sums are exact in any order.

Components become floor(scale * x), so a round gives the same centroids however the rows are dealt and whichever tasks are
run again. A round reads the vectors where they lie, with centroids broadcast; only counts and sums by centroid leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutgrain.session import bounded, cut

#: Integers up to this have squared distances that fit a long, for as many components as there may be; larger ones go as Python integers.
SMALL = 1 << 24
#: Components that SMALL allows: 2^13 squares of differences below 2^25.
MOST_COMPONENTS = 1 << 13
#: Sums leave a task as limbs of so many bits, so that sums of any size merge as longs and decimals.
LIMB = 48
#: Rows compared with a centroid at once.
ROWS = 4096


def whole_numbers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as long, or as Python integers where one is beyond SMALL."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    if x.shape[1] <= MOST_COMPONENTS and np.abs(x).max(initial=0.0) * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(np.floor(v * scale)) if abs(v) < 1 << 52 else int(v) * scale
    return np.array([[whole(v) for v in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equally near ones, and its squared distance."""
    if np.abs(centroids).max(initial=0) >= SMALL:
        x = x.astype(object)
    if x.dtype != object:
        centroids = centroids.astype(np.int64)
    which, least = [np.empty(0, np.int64)], [np.empty(0, x.dtype)]
    for lo in range(0, len(x), ROWS):
        part = x[lo : lo + ROWS]
        d = np.empty((len(centroids), len(part)), x.dtype)
        for k, c in enumerate(centroids):
            diff = part - c
            d[k] = (diff * diff).sum(1)
        own = d.argmin(0)
        which.append(own)
        least.append(d[own, np.arange(len(part))])
    return np.concatenate(which), np.concatenate(least)


def _limbs(x: int) -> list[int]:
    """x as limbs of LIMB bits, the least first; all have its sign."""
    sign, x, out = (1 if x >= 0 else -1), abs(x), []
    while x:
        out.append(sign * (x & (1 << LIMB) - 1))
        x >>= LIMB
    return out


def _kept(rows: DataFrame, vector: str, size: int) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size(v) == size) & ~bad)


def _first(kept: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in this order, as rows of whole numbers."""
    ranked = kept.where("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "vector")
    got = [r["vector"] for r in ranked.orderBy("h", "vector").limit(k).collect()]
    return whole_numbers(got, scale).astype(object) if got else np.empty((0, 0), object)


def _sums(kept: DataFrame, centroids: Broadcast, scale: int) -> list:
    """Counts and component sums by centroid: rows (k, pos, limb, total), pos -1 with the count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        totals = np.zeros(c.shape, object)
        counts = np.zeros(len(c), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = whole_numbers(b["vector"].tolist(), scale)
            own, _ = nearest(x, c)
            counts += np.bincount(own, minlength=len(c))
            for j in np.unique(own):
                totals[j] += x[own == j].sum(0).astype(object)
        out = [(j, -1, 0, int(n)) for j, n in enumerate(counts) if n]
        out += [(j, p, i, part) for j in np.flatnonzero(counts).tolist() for p, total in enumerate(totals[j]) for i, part in enumerate(_limbs(int(total)))]
        yield pd.DataFrame(out, columns=["k", "pos", "limb", "total"]).astype({"k": "int32", "pos": "int32", "limb": "int32", "total": "int64"})

    parts = bounded(kept).select("vector").mapInPandas(run, "k int, pos int, limb int, total long")
    return parts.groupBy("k", "pos", "limb").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()


def _moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; those without vectors stay."""
    count = {r["k"]: int(r["total"]) for r in sums if r["pos"] < 0}
    total = np.zeros(centroids.shape, object)
    for r in sums:
        if r["pos"] >= 0:
            total[r["k"], r["pos"]] += int(r["total"]) << LIMB * r["limb"]
    return np.array([[t // count[j] for t in total[j]] if j in count else list(c) for j, c in enumerate(centroids)], object).reshape(centroids.shape)


def fit(rows: DataFrame, k: int, rounds: int, size: int, salt: str = "", scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids (rows of Python integers) after so many rounds, started from the k vectors whose sha256 of salt and id is least.

    Vectors count that have `size` components, none null or non-finite. Fewer than k of them make fewer centroids; none make
    none. Null ids are clustered but start no centroid; of repeated ids each row may, the smaller vector first.
    """
    kept = _kept(rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "vector", size)
    centroids, sc = _first(kept, k, salt, scale), rows.sparkSession.sparkContext
    for _ in range(rounds if len(centroids) else 0):
        sent = sc.broadcast(centroids)  # k times `size` numbers, whatever the table's size
        centroids = _moved(centroids, _sums(kept, sent, scale))
        sent.destroy()
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, size: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """-> (id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) of each vector that counts.

    Equally near centroids: the smaller number. Rows that repeat an id are assigned each; null ids stay null; other columns
    are dropped. A distance or a sum that doesn't fit a long is null. No centroids, or an empty table: no rows.
    """
    spark = rows.sparkSession
    kept = _kept(rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "vector", size)
    sent, most = spark.sparkContext.broadcast(centroids), (1 << 63) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(sent.value):
                continue
            own, d = nearest(whole_numbers(b["vector"].tolist(), scale), sent.value)
            fits = d if d.dtype != object else pd.array([x if x <= most else None for x in d], "Int64")
            yield pd.DataFrame({"id": b["id"], "cluster": own.astype(np.int32), "distance": fits})

    kind = kept.schema["id"].dataType.simpleString()
    got = cut(bounded(kept).mapInPandas(run, f"id {kind}, cluster int, distance long"))
    sent.destroy()
    own = got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("missing"))
    every = Window.partitionBy()  # over one row a centroid
    sums = own.select("cluster", F.when(F.col("missing") == 0, F.col("d")).try_cast("long").alias("cluster_inertia"), F.when(F.sum("missing").over(every) == 0, F.sum("d").over(every)).try_cast("long").alias("inertia"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return got.join(F.broadcast(sums), "cluster").join(F.broadcast(names), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
