"""Near-duplicate vectors: all pairs over a cosine by dual traversal of cover trees.

Vectors become unit vectors, where a cosine is a distance. Equal vectors of a label are one point with a multiplicity.
The points of a label are dealt to the nearest of a few pivots, which are the top of the label's tree: two cells whose
pivots are farther apart than their covering radii and the threshold are never compared. Cells are cut into blocks of
bounded size, and each remaining pair of blocks is one group: both blocks get a cover tree, whose nested levels halve
their radii, and the trees are descended together; a pair of nodes is pruned where its centres' distance less both
covering radii exceeds the threshold, and counted whole where the distance and both radii stay below it.

A group returns link counts and a spanning forest of its links, at most one row a point for each, so that a cluster of
any size never becomes its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.rows import small
from cutgrain.llm.vectors import is_usable, unit
from cutgrain.operators.components import connected_components
from cutgrain.session import bounded, cut

#: Points of a block, about.
BLOCK = 4096
#: Pivots of a label at most; beyond, cells are cut into more blocks.
PIVOTS = 1024
#: Points that meet a label's pivots together.
DEAL = 8192
#: Nodes with this many points aren't split.
LEAF = 48
#: Slack of bounds on distances: rounding of a distance near 0 is the root of that of a product, some 2e-8, and a bound adds
#: three of them. What bounds don't decide, products do.
SLACK = 1e-7
#: Products this close to the threshold are computed again one by one in double precision.
EPS = 1e-9


class Node:
    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, centre: int, points: np.ndarray, radius: float, children: list) -> None:
        self.centre, self.points, self.radius, self.children = centre, points, radius, children


def build(x: np.ndarray) -> Node:
    """A cover tree of unit vectors: a node's children are centred on its points, at least the children's reach apart,
    and reach half as far; a node's own centre is one of them. radius is the true covering radius."""

    def node(centre: int, points: np.ndarray, away: np.ndarray, reach: float) -> Node:
        radius = float(away.max())
        if len(points) <= LEAF or radius <= 1e-7:
            return Node(centre, points, radius, [])
        reach = min(reach, radius) / 2
        children, at, left, far = [], centre, points, away
        while True:
            near = far <= reach
            near[left == at] = True
            children.append(node(at, left[near], far[near], reach))
            left = left[~near]
            if not len(left):
                return Node(centre, points, radius, children)
            at = int(left[0])
            far = distance(x[left], x[at])

    return node(0, np.arange(len(x)), distance(x, x[0]), 2.0)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b), 0))


def links(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of x's and of y's points, and pairs that connect what is linked. y None: x with itself."""
    own = y is None
    if own:
        y, wy = x, wx
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    most = math.sqrt(2 - 2 * cosine)
    forest: list[tuple[int, int]] = []
    parent = list(range(len(x) + (0 if own else len(y))))
    shift = 0 if own else len(x)

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(a: int, b: int) -> None:
        ra, rb = root(a), root(b + shift)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            forest.append((a, b))

    def whole(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """All of p links with all of q."""
        nx[p] += wy[q].sum()
        if same:
            nx[p] -= wy[p]
        elif own:
            nx[q] += wx[p].sum()
        else:
            ny[q] += wx[p].sum()
        for b in q:
            join(int(p[0]), int(b))
        for a in p[1:]:
            join(int(a), int(q[0]))

    def leaves(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        hit = x[p] @ y[q].T
        near = np.abs(hit - cosine) < EPS
        if near.any():  # as one by one in double precision
            for i, j in zip(*np.nonzero(near), strict=True):
                hit[i, j] = float(np.dot(x[p[i]], y[q[j]]))
        hit = hit >= cosine
        if same:
            np.fill_diagonal(hit, False)
        nx[p] += hit @ wy[q]
        if own and not same:
            nx[q] += wx[p] @ hit
        elif not own:
            ny[q] += wx[p] @ hit
        for i, j in zip(*np.nonzero(hit), strict=True):
            join(int(p[i]), int(q[j]))

    tx = build(x)
    stack = [(tx, tx if own else build(y))]
    while stack:
        a, b = stack.pop()
        same = own and a is b
        if not same:
            d = float(np.sqrt(max(2 - 2 * float(x[a.centre] @ y[b.centre]), 0)))
            if d - a.radius - b.radius > most + SLACK:
                continue
            if d + a.radius + b.radius < most - SLACK:
                whole(a.points, b.points, False)
                continue
        elif 2 * a.radius < most - SLACK:
            whole(a.points, a.points, True)
            continue
        if not a.children and not b.children:
            leaves(a.points, b.points, same)
        elif same:
            kids = a.children
            stack += [(k, k) for k in kids] + _near(x, y, kids, kids, most, True)
        elif not b.children or a.children and a.radius >= b.radius:
            stack += _near(x, y, a.children, [b], most, False)
        else:
            stack += _near(x, y, [a], b.children, most, False)
    return nx, ny, forest


def _near(x: np.ndarray, y: np.ndarray, p: list[Node], q: list[Node], most: float, upper: bool) -> list[tuple[Node, Node]]:
    """Pairs of nodes that the covering radii don't exclude."""
    d = np.sqrt(np.maximum(2 - 2 * (x[[k.centre for k in p]] @ y[[k.centre for k in q]].T), 0))
    keep = d - np.array([k.radius for k in p])[:, None] - np.array([k.radius for k in q])[None, :] <= most + SLACK
    if upper:
        keep = np.triu(keep, 1)
    return [(p[i], q[j]) for i, j in zip(*np.nonzero(keep), strict=True)]


def _points(rows: DataFrame) -> DataFrame:
    """(label, e1, e2, embedding array<double>) of usable rows -> (label, dim, point, e1, e2, w, embedding), cut: distinct
    vectors of a label, and how many rows have each."""
    points = rows.groupBy("label", "e1", "e2").agg(F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    return cut(points.select("label", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("point"), "e1", "e2", "w", "embedding"))


def _celled(points: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Points with the nearest of their label's pivots, `cell`, and their distance from it, `away`; and the pivots."""
    sizes = cut(points.groupBy("label", "dim").agg(F.count("*").alias("n")))
    sizes = sizes.withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK)).cast("int")).withColumn("deals", F.ceil(F.col("n") / DEAL).cast("int"))
    ranked = points.join(small(sizes), ["label", "dim"])
    # pivots: about that many of each label by hash, at most 2 x PIVOTS, and one in any case
    mark = F.pmod(F.xxhash64("point", F.lit(5)), F.lit(1 << 30))
    picked = ranked.where(mark < F.col("pivots") / F.col("n") * (1 << 30)).groupBy("label", "dim").agg(F.slice(F.array_sort(F.collect_list(F.struct(mark.alias("m"), "embedding"))), 1, 2 * PIVOTS).alias("some"))
    least = ranked.groupBy("label", "dim").agg(F.min_by("embedding", mark).alias("one"))
    pivots = least.join(picked, ["label", "dim"], "left").select("label", "dim", F.when(F.size("some") > 0, F.transform("some", lambda s: s["embedding"])).otherwise(F.array("one")).alias("pivots"))
    pivots = cut(pivots)
    left = ranked.select("label", "dim", F.pmod("point", "deals").cast("int").alias("deal"), "point", "w", "embedding")
    right = pivots.join(sizes.select("label", "dim", "deals"), ["label", "dim"]).select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "pivots")
    right = right.toDF("plabel", "pdim", "pdeal", "pivots")

    def run(key: tuple, t: pa.Table, p: pa.Table) -> pa.Table:
        cell, away = np.empty(len(t), np.int32), np.empty(len(t))
        if len(t):
            dim = key[1].as_py()
            near = unit(p["pivots"].combine_chunks().flatten().flatten().to_numpy().reshape(-1, dim))
            x = unit(t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
            for lo in range(0, len(x), 512):
                d = x[lo : lo + 512] @ near.T
                cell[lo : lo + 512] = d.argmax(1)
                away[lo : lo + 512] = np.sqrt(np.maximum(2 - 2 * d.max(1), 0))
        return t.drop_columns(["deal"]).append_column("cell", pa.array(cell)).append_column("away", pa.array(away))

    return cut(left.groupBy("label", "dim", "deal").cogroup(right.groupBy("plabel", "pdim", "pdeal")).applyInArrow(run, f"label {kind}, dim int, point long, w long, embedding array<double>, cell int, away double")), pivots


def near_vectors(rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """-> (vec_id, n_links, component_id, kept): one row a row of rows.

    Rows with equal labels, and vectors of equal lengths, link where the cosine in double precision is at least `cosine`.
    Null labels, and vectors that are null, zero, or hold null or non-finite components, link with nothing. Null ids take
    no part and are returned with no links. Rows that repeat an id count their links one by one and join what each of them
    is linked with, also across labels. An empty table gives no rows; other columns are dropped.
    """
    rows = bounded(rows).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & is_usable("embedding")
    digests = [F.xxhash64("embedding"), F.xxhash64(F.lit(17), "embedding")]
    kind = rows.schema["label"].dataType.simpleString()
    points = _points(rows.where(ok).select("label", digests[0].alias("e1"), digests[1].alias("e2"), "embedding"))
    celled, pivots = _celled(points, kind)
    cells = celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    cells = cells.join(pivots, ["label", "dim"]).select("label", "dim", "cell", "n", "radius", F.element_at("pivots", F.col("cell") + 1).alias("pivot"))
    cells = cut(cells.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    left, right = (cells.select("label", "dim", *[F.col(c).alias(f"{c}{k}") for c in ("cell", "radius", "pivot", "parts")]) for k in "ab")
    apart = F.sqrt(F.greatest(2 - 2 * dot("pivota", "pivotb") / F.sqrt(dot("pivota", "pivota") * dot("pivotb", "pivotb")), F.lit(0.0)))
    met = left.join(right, ["label", "dim"]).where("cella <= cellb").where(apart - F.col("radiusa") - F.col("radiusb") <= math.sqrt(2 - 2 * cosine) + 1e-6)
    blocks = met.select("label", "dim", "cella", "cellb", F.explode(F.sequence(F.lit(0), F.col("partsa") - 1)).alias("parta"), "partsb").select("label", "dim", "cella", "cellb", "parta", F.explode(F.sequence(F.lit(0), F.col("partsb") - 1)).alias("partb"))
    blocks = blocks.where("cella < cellb or parta <= partb")
    # each block of a pair is asked for once; side 0 is the first of a pair, a block with itself has one side
    sides = blocks.select("label", "dim", "cella", "cellb", "parta", "partb", F.explode(F.when((F.col("cella") == F.col("cellb")) & (F.col("parta") == F.col("partb")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.select("label", "dim", F.concat_ws(":", "cella", "parta", "cellb", "partb").alias("pair"), "side", F.when(F.col("side") == 0, F.col("cella")).otherwise(F.col("cellb")).alias("cell"), F.when(F.col("side") == 0, F.col("parta")).otherwise(F.col("partb")).alias("part"))
    parts = celled.join(small(cells.select("label", "dim", "cell", "parts")), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
    asked = parts.select("label", "dim", "cell", "part", "point", "w", "embedding").join(small(cut(sides)), ["label", "dim", "cell", "part"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, pair = key[1].as_py(), key[2].as_py().split(":")
        t = t.sort_by([("side", "ascending"), ("point", "ascending")])
        side = t["side"].to_numpy()
        x = unit(t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        w, ids = t["w"].to_numpy(), t["point"].to_numpy()
        a, b = side == 0, side == 1
        empty = np.empty(0, np.int64)
        if not a.any() or not b.any() and pair[:2] != pair[2:]:
            return pa.table({"src": empty, "dst": empty, "n": empty})
        ra, rb = ids[a], ids[b] if b.any() else ids[a]
        na, nb, forest = links(x[a], x[b] if b.any() else None, w[a], w[b] if b.any() else None, cosine)
        some = np.concatenate([ra[na > 0], rb[nb > 0]])
        ends = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table({"src": np.concatenate([some, ra[ends[:, 0]]]), "dst": np.concatenate([some, rb[ends[:, 1]]]), "n": np.concatenate([na[na > 0], nb[nb > 0], np.zeros(len(ends), np.int64)])})

    found = cut(asked.groupBy("label", "dim", "pair").applyInArrow(run, "src long, dst long, n long"))
    counts = found.where("src = dst").groupBy(F.col("src").alias("point")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("src != dst")).select(F.col("id").alias("point"), "component")
    by_point = points.select("label", "e1", "e2", "point", "w").join(counts, "point", "left").join(comps, "point", "left")
    by_point = by_point.select(F.col("label").alias("own_label"), "e1", "e2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    every = rows.select("vec_id", F.when(ok, F.col("label")).alias("own_label"), *[F.when(ok, d).alias(c) for c, d in zip(("e1", "e2"), digests, strict=True)])
    got = cut(every.join(cut(by_point), ["own_label", "e1", "e2"], "left").select("vec_id", "n_links", "component"))
    # an id of several components joins them; a component is known by its smallest id
    linked = got.where("component is not null")
    several = linked.groupBy("vec_id").agg(F.min("component").alias("src"), F.max("component").alias("dst")).where("src < dst").select("vec_id", "src")
    more = cut(linked.join(several, "vec_id").select("src", F.col("component").alias("dst")).where("src < dst").distinct())
    if not more.isEmpty():
        joined = cut(connected_components(more).select(F.col("id").alias("component"), F.col("component").alias("joined")))
        got = cut(got.join(small(joined), "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined"))
    least = got.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))
    got = got.join(small(cut(least.where("least < most").select("component", "least"))), "component", "left")
    component = F.coalesce("least", "vec_id")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
