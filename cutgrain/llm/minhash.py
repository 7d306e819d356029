"""Near-duplicate texts by min-max hashing, confirmed on full shingle sets.

Each permutation is evaluated once and gives two coordinates, the least and the greatest value, so 64 evaluations
make a signature of 128. Bands of four coordinates (two permutations) find candidates: at a similarity of 0.8 a pair
shares no band with a probability below 1e-7.

Rows with equal sets form a class first, and only one row of each class is compared. Buckets join classes into
clusters, and a cluster's members meet in groups of at most two blocks of bounded size, where pairs that share a band
and aren't connected yet are compared on full sets; only links come out. In a cluster of several blocks every member is
first compared with one leader, and then only members outside the largest component meet the others, so that a group of
copies of any size costs little more than its size; clusters of one block skip that step, which would give them the same
links. Every pair that shares a band is thus either in one component or has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.rows import keyed, sliced, small, wrapped
from cutgrain.llm.shingles import isin_sorted, mix, shingles, word_hashes
from cutgrain.operators.components import connected_components
from cutgrain.session import cut

PERMUTATIONS = 64
BANDS = 32
#: Members of a block, and shingles that they have together, about; a larger set is still held whole.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(7919)
_MASK = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_ODD = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BANDS) keys of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    key = np.broadcast_to(_SALT, (len(sets), BANDS)).copy()
    for j in range(PERMUTATIONS):
        v = (flat ^ _MASK[j]) * _ODD[j]
        b = j * BANDS // PERMUTATIONS
        key[:, b] = mix(key[:, b] * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(v, at))
        key[:, b] = mix(key[:, b] * np.uint64(0xD6E8FEB86659FD93) + np.maximum.reduceat(v, at))
    return key


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, copy, text) -> (doc_id, t, copy, n, d1, d2, bands): set size, 128-bit digest of the set, band keys (empty
    set: none)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(word_hashes(t), k) if t else np.empty(0, np.uint64) for t in b.column(3).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        n = np.array([len(s) for s in sets], np.int64)
        d1, d2, keys = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.empty((0, BANDS), np.uint64)
        if full:
            keys = band_keys([sets[i] for i in full])
            d1[full] = [mix(sets[i]).sum() for i in full]
            d2[full] = [mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum() for i in full]
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))], names=["doc_id", "t", "copy", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(sliced(run), "doc_id long, t long, copy boolean, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, t, copy, text) and nodes (node, rid, rt), which have been cut -> (node, shingles array<long>)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(word_hashes(t or ""), k) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    # where nodes are few, texts aren't shuffled
    texts = docs.where("not copy").join(small(asked), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("t") == F.col("rt")))
    return texts.select("node", "text").mapInArrow(sliced(run), "node long, shingles array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, na, nb) -> those (src, dst) whose full sets are similar enough."""
    pairs = cut(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct())
    nodes = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    sets = _sets(docs, cut(nodes.join(reps.select("node", "rid", "rt"), "node")), k)
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    same = two.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("x"))
    return same.where(100 * F.col("x") >= percent * (F.col("na") + F.col("nb") - F.col("x"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _links(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Nodes of one block or two that meet -> links that join components, each compared on full sets."""
    t = t.sort_by("node")
    node, comp, part = t["node"].to_pylist(), t["comp"].to_pylist(), t["part"].to_numpy()
    flat = lambda name: t[name].combine_chunks()
    items, at = flat("shingles").flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(flat("shingles").value_lengths().to_numpy()))
    size = np.diff(at)
    bands = flat("bands").flatten().to_numpy().reshape(len(node), -1)
    shared = np.zeros((len(node), len(node)), np.int16)
    for c in range(bands.shape[1]):
        shared += bands[:, c][:, None] == bands[:, c][None, :]
    ok = (shared > 0) & (100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :]))
    if t["i"][0] != t["j"][0]:
        ok &= part[:, None] != part[None, :]  # a block has met itself elsewhere
    x, y = np.nonzero(np.triu(ok, 1))
    same = {c: c for c in comp}

    def root(c: int) -> int:
        while same[c] != c:
            same[c] = same[same[c]]
            c = same[c]
        return c

    out = []
    for i in np.argsort(-shared[x, y], kind="stable"):  # likely links first: what they connect needs no comparison
        p, q = int(x[i]), int(y[i])
        cp, cq = root(comp[p]), root(comp[q])
        if cp != cq:
            a, b = sorted((items[at[p] : at[p + 1]], items[at[q] : at[q + 1]]), key=len)
            both = int(isin_sorted(a, b).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                out.append((node[p], node[q]))
                same[cp] = cq
    return out


def _confirm_clusters(members: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(cluster, node, comp, n, minor, bands), which has been cut -> links (src, dst) that join components of a cluster."""
    # minor members are dealt to blocks 0 ... m - 1 and meet every block, major ones to m ... m + l - 1 and meet the minor blocks
    blocks = lambda of: F.ceil(F.greatest(F.count_if(of) / BLOCK, F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = cut(members.groupBy("cluster").agg(blocks(F.col("minor")).alias("m"), blocks(~F.col("minor")).alias("l")).where("m > 0"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("m")).otherwise(F.col("l"))).cast("int") + F.when(F.col("minor"), 0).otherwise(F.col("m"))
    dealt = members.join(small(sizes), "cluster").withColumn("part", own)
    others = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("m") + F.col("l")).otherwise(F.col("m")) - 1)
    sets = _sets(docs, cut(members.select("node").join(reps.select("node", "rid", "rt"), "node")), k)
    full = dealt.join(sets, "node").select("cluster", "node", "comp", "part", "bands", "shingles", F.explode(others).alias("o"))
    met = full.select("cluster", "node", "comp", "part", "bands", "shingles", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        found = _links(t, percent)
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return met.groupBy("cluster", "i", "j").applyInArrow(run, "src long, dst long").distinct()


def _components(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Signatures, which have been cut, and their rows -> (d1, d2, n, node, component), cut: each class of equal sets, and the
    least node of the classes that it is linked with."""
    some = rows.where("n > 0 and not copy")
    reps = some.groupBy("d1", "d2", "n").agg(F.first("doc_id").alias("rid"), F.first("t").alias("rt"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead")).where("size > 1")
    near = cut(banded.join(shared.select("key", "lead"), "key").where("lead < node").select("node", "lead").distinct())
    clusters = connected_components(near, "node", "lead").select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    clusters = cut(clusters.join(reps.select("node", "n", "bands"), "node"))
    large = cut(clusters.groupBy("cluster").agg(F.count("*").alias("size")).where(f"size > {BLOCK}"))
    comps = None
    if not large.isEmpty():
        # clusters of several blocks: one leader for each member first, the least node of its buckets
        several = clusters.join(small(large), "cluster").select("node", "n")
        first = near.groupBy("node").agg(F.min("lead").alias("b")).join(several, "node").select(F.col("node").alias("a"), "b", F.col("n").alias("na"))
        links = _confirm(first.join(several.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"), docs, reps, k, percent)
        comps = cut(connected_components(links))
        clusters = cut(clusters.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
        own = clusters.groupBy("cluster", "comp").agg(F.count("*").alias("own"))
        most = cut(own.groupBy("cluster").agg(F.max_by("comp", F.struct("own", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1"))
        work = clusters.join(small(most), "cluster").select("cluster", "node", "comp", "n", "bands", (F.col("comp") != F.col("most")).alias("minor"))
    else:
        work = clusters.select("cluster", "node", F.col("node").alias("comp"), "n", "bands", F.lit(True).alias("minor"))
    more = _confirm_clusters(cut(work), docs, reps, k, percent)
    if comps is not None:
        more = more.union(comps.select(F.col("id").alias("src"), F.col("component").alias("dst")))
    comps = connected_components(more)
    return cut(reps.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("d1", "d2", "n", "node", F.coalesce("component", "node").alias("component")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, copy, text) of every row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keyed(plain, nulls=True).select("doc_id", F.col("__t").alias("t"), F.col("__copy").alias("copy"), "text")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_shingles, component_id, kept): one row a row of docs.

    Two rows are linked where 100 x shared shingles >= percent x all their shingles; component_id is the smallest id
    reachable by links and kept says that it is the row's own. Texts without words, and null texts, have no shingles and
    link with nothing. A text's shingles are hashed whole in its task, at some twenty times its size. A null id links with nothing, has a null component and is kept. Rows that repeat an id are one
    vertex with several sets, which links what each of them is linked with. An empty table gives no rows; other columns are
    dropped.
    """
    own = _rows(docs, id_col, text_col)
    rows = cut(signatures(own, k))
    some = rows.where("doc_id is not null")
    classes = _components(some, own, k, percent)
    linked = some.where("n > 0").select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("doc_id", "component")
    # an id of several components joins them
    several = linked.groupBy("doc_id").agg(F.min("component").alias("src"), F.max("component").alias("dst")).where("src < dst").select("doc_id", "src")
    more = cut(linked.join(several, "doc_id").select("src", F.col("component").alias("dst")).where("src < dst").distinct())
    if not more.isEmpty():
        joined = cut(connected_components(more).select(F.col("id").alias("component"), F.col("component").alias("joined")))
        classes = cut(classes.join(small(joined), "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined"))
    with_class = rows.select("doc_id", "d1", "d2", "n").join(classes.select("d1", "d2", "n", "component"), ["d1", "d2", "n"], "left")
    # a component's smallest id: of those whose ids are other than that, there are at most as many as rows
    least = with_class.where("component is not null and doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = cut(least.where("least < most").select("component", "least"))
    got = with_class.join(small(least), "component", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    got = got.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of rows that links connect, the one with the smallest doc_id stays.

    Here every row is a vertex of its own: rows that repeat an id are connected only by their texts, as are those with null
    ids, which come after all others. Of rows with the same id, one is taken by a hash of its text. Rows without words
    all stay. Columns and their names are kept as they are; an empty table gives no rows.
    """
    own = keyed(wrapped(docs), nulls=True, id_col="id")
    plain = own.select(F.col("id").alias("doc_id"), F.col("__t").alias("t"), F.col("__copy").alias("copy"), "text")
    rows = cut(signatures(plain, k))
    classes = _components(rows, plain, k, percent)
    linked = rows.where("n > 0").select("doc_id", "t", "copy", "d1", "d2", "n").join(classes.select("d1", "d2", "n", "component"), ["d1", "d2", "n"])
    linked = cut(linked.select("doc_id", "t", "copy", "component"))
    best = linked.groupBy("component").agg(F.min("doc_id").alias("best"))
    firsts = linked.join(cut(best), "component").where("not copy and doc_id <=> best").groupBy("component").agg(F.first("doc_id").alias("best"), F.min("t").alias("t0"))
    gone = linked.join(cut(firsts), "component").where("copy or not (doc_id <=> best) or t != t0")
    gone = cut(gone.select(F.col("doc_id").alias("__gone"), F.col("t").alias("__gt"), F.col("copy").alias("__gc")).distinct())
    same = F.col("id").eqNullSafe(F.col("__gone")) & (F.col("__t") == F.col("__gt")) & (F.col("__copy") == F.col("__gc"))
    return own.join(small(gone), same, "left_anti").select("row.*")
