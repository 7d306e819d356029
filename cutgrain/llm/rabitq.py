"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is rotated by a random orthogonal matrix and kept as the signs of its components (packed bits), its length, and
the cosine between it and its code. An inner product with a query is estimated from the bits and these two scalars; the
estimator is unbiased over rotations, and its error has a bound that shrinks with the dimension. Candidates whose upper
bound reaches the k-th largest lower bound are reranked with the original vectors in double precision.

Queries and candidates are dealt into blocks, and each pair of blocks is one group of bounded size: within it, the exact
products of the best estimates give a query its k-th best so far, and what can't reach that by its bound is left out. A
group returns k rows a query, which a ranked window merges. Candidates are copied once for each block of queries, so work
grows with queries times candidates, and a thousandfold table has a thousand times the blocks of either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutgrain.llm.vectors import is_usable, unit
from cutgrain.session import bounded, cut

CANDIDATES = 8192
QUERIES = 8192
#: Standard errors in a bound: the estimate's error is Gaussian-like, so one in some 700 neighbours is missed.
EPSILON = 3.0
#: Queries estimated at once in a group.
CHUNK = 256


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix for a dimension everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(40_009 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, d) -> packed signs, lengths, cosines between vectors and their codes."""
    y = unit(x) @ rotation(x.shape[1])
    return np.packbits(y > 0, axis=1), np.linalg.norm(x, axis=1), np.abs(y).sum(1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, cosine: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x candidates) of unit vectors q in single precision, and a bound of the error for each candidate."""
    d = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    est = (q @ rotation(d)).astype(np.float32) @ (signs / (cosine * np.sqrt(d)).astype(np.float32)[:, None]).T
    spread = np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine * (EPSILON / np.sqrt(max(d - 1, 1)))
    return est, (spread + 1e-5).astype(np.float32)  # with the slack of single precision


def nearest(x: np.ndarray, codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, ids: np.ndarray, own: np.ndarray, y: np.ndarray, asker: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of y (its place, places of its best candidates, their products). own and asker: rows, of which a query
    leaves out its own."""
    size = np.linalg.norm(y, axis=1)
    for lo in range(0, len(y), CHUNK):
        q = y[lo : lo + CHUNK]
        est, bound = estimate(codes, cosine, unit(q))
        middle, high = est * length, (est + bound) * length  # in double precision, over the query's length
        mine = np.searchsorted(own, asker[lo : lo + CHUNK])
        mine[mine == len(own)] = 0
        here = np.flatnonzero(own[mine] == asker[lo : lo + CHUNK])
        middle[here, mine[here]] = high[here, mine[here]] = -np.inf
        least = np.full(len(q), -np.inf)
        if len(own) > 2 * k:
            some = np.argpartition(middle, len(own) - 2 * k, axis=1)[:, len(own) - 2 * k :]
            exact = np.where(own[some] == asker[lo : lo + CHUNK, None], -np.inf, np.einsum("ijk,ik->ij", x[some], q))
            tau = np.partition(exact, k, axis=1)[:, k]  # k of 2 k reach it
            least = tau / size[lo : lo + CHUNK] - 1e-12 * np.abs(tau / size[lo : lo + CHUNK])
        for i in range(len(q)):
            at = np.flatnonzero(high[i] >= least[i])
            at = at[own[at] != asker[lo + i]]
            if len(at) > k:  # products up to rounding leave few for those that count
                s = x[at] @ q[i]
                at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * np.abs(s).max()]
            s = (x[at] * q[i]).sum(1)
            best = np.lexsort((ids[at], -s))[:k]
            yield lo + i, at[best], s[best]


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """-> (query_id, rank, vec_id, score): each query's k candidates of the largest inner product found, ties to the
    smaller id; score is the inner product of the original vectors in double precision.

    Queries are rows for which is_query holds; a query's candidates are all other rows of the same length. Vectors that are
    null, zero or hold null or non-finite components, and null ids, take no part. Rows that repeat an id are queries and
    candidates each. With fewer candidates than k all are returned; none, or an empty table, give no rows. Other columns are
    dropped.
    """
    good = bounded(rows).where(F.col(id_col).isNotNull() & is_usable(vector))
    kind = rows.schema[vector].dataType.simpleString()
    good = good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("vector"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            sizes = vectors.value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                one = b.filter(pa.array(sizes == dim))
                codes, length, cosine = encode(one.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(cosine)], names=[*one.schema.names, "code", "length", "cosine"])

    # cut, so that a row keeps its number
    coded = cut(good.mapInArrow(index, f"row long, vec_id long, asks boolean, vector {kind}, code binary, length double, cosine double"))
    n, m = coded.agg(F.count("*"), F.count_if("asks")).first()
    parts, asks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    dim = F.size("vector").alias("dim")
    left = coded.select(dim, F.pmod("row", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))).alias("ask"), "row", "vec_id", "vector", "code", "length", "cosine")
    right = coded.where("asks").select(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("row"), F.lit(asks)).alias("ask"), F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    right = right.toDF("qdim", "qpart", "qask", "asker", "query_id", "query")

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(c) and len(q):
            flat = lambda t, name: t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, key[0].as_py())
            c = c.sort_by("row")
            codes = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(len(c), -1)
            ids, asker, query = c["vec_id"].to_numpy(), q["asker"].to_numpy(), q["query_id"].to_numpy()
            for i, at, s in nearest(flat(c, "vector"), codes, c["length"].to_numpy(), c["cosine"].to_numpy(), ids, c["row"].to_numpy(), flat(q, "query"), asker, k):
                for col, x in zip(out, (np.full(len(at), asker[i]), np.full(len(at), query[i]), ids[at], s), strict=True):
                    col.append(x)
        return pa.table(dict(zip(("asker", "query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    found = left.groupBy("dim", "part", "ask").cogroup(right.groupBy("qdim", "qpart", "qask")).applyInArrow(run, "asker long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
