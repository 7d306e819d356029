"""Clustering, sharding and runs of words against brute force and SQL, on small tables that hold the awkward cases."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cutgrain.llm import lloyd, periodic, registry, repeats, sharding

# op11


def lloyd_by_hand(rows, k, rounds, size, salt, scale=256):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept] if cs else []
    fits = lambda x: x if x is not None and x < 2**63 else None
    total = lambda ds: sum(ds) if all(fits(d) is not None for d in ds) else None
    per = {j: total([d for _, c, d in out if c == j]) for j in range(len(cs))}
    every = total([d for _, _, d in out])
    return sorted((repr(i), j, fits(d), fits(per[j]), fits(every), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in out)


VECTORS = [(i, [math.sin(i * (j + 1)) * (1 + i % 3) for j in range(4)]) for i in range(40)] + [
    (3, [0.5, 0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5, 0.5]), (100, None), (101, [1.0, 2.0, 3.0]), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]),
    (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [0.0, 0.0, 0.0, 0.0]), (106, []), (None, [0.25, -0.25, 1e-9, -1e-9]), (107, [-0.001] * 4),
]


def clustered(spark, rows, k, rounds=5, size=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("id", F.lit(0)).withColumn("k", F.lit(0)).repartition(3)
    got = lloyd.assign(df, lloyd.fit(df, k, rounds, size, "2:"), size)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r[0]), *r[1:]) for r in got.collect())


@pytest.mark.parametrize("k", [1, 7, 200])
def test_lloyd(spark, k):
    assert clustered(spark, VECTORS, k) == lloyd_by_hand(VECTORS, k, 5, 4, "2:")


def test_lloyd_with_components_beyond_longs(spark):
    rows = [*VECTORS, (500, [3e38, -3e38, 1.0, 0.5]), (501, [3e38, -3e38, 1.0, 0.75]), (502, [5e6, 0.0, 0.0, 0.0])]
    assert clustered(spark, rows, 9) == lloyd_by_hand(rows, 9, 5, 4, "2:")


def test_lloyd_of_nothing(spark):
    assert clustered(spark, [], 5) == [] and clustered(spark, [(1, None), (2, [1.0])], 5) == []


# op12


def placed(spark, tmp_path, rows, **kind):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("row", F.lit(0)).withColumn("vslot", F.lit(0)).withColumn("shard", F.lit(0)).repartition(5)
    got = sharding.place(df, 8, f"{tmp_path}/map", **kind).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(repr, ((i, size(t), crc(t)) for i, t in rows)))
    by = collections.defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return got, [sum(r.size for r in by[s]) for s in range(8)]


def test_shards_are_of_near_equal_bytes(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "é" * int(r.paretovariate(1.1) * 20)) for i in range(3000)] + [(None, None), (None, None), (7, ""), (-3, "x")]
    _, load = placed(spark, tmp_path, rows)
    assert max(load) - min(load) <= max(len(t.encode()) + 1 for _, t in rows if t is not None)
    assert max(load) <= 1.01 * sum(load) / 8


def test_a_third_of_all_rows_being_one_record_is_split(spark, tmp_path):
    rows = [(1, "the same " * 9)] * 2000 + [(i, f"other {i} " * 9) for i in range(4000)] + [(5, "again " * 9 + str(i)) for i in range(500)]
    got, load = placed(spark, tmp_path, rows)
    assert max(load) <= 1.01 * sum(load) / 8 and len({r.shard for r in got if r.doc_id == 1}) == 8
    now = sharding.SlotMap.load(spark, f"{tmp_path}/map")
    assert now.version == 2 and now.split


def test_shards_of_nothing(spark, tmp_path):
    got, load = placed(spark, tmp_path, [])
    assert got == [] and sum(load) == 0


def test_maps_are_versioned_and_grow_by_moves_into_the_new_shard(spark, tmp_path):
    sizes = np.random.default_rng(3).integers(0, 1000, 512)
    first = sharding.SlotMap.even(8, 512)
    second = first.rebalanced(sizes)
    third = second.grown(sizes)
    before = None
    for m in (first, second, third):
        m.save(spark, f"{tmp_path}/m", before)
        before = m
    for m in (first, second, third):
        got = sharding.SlotMap.load(spark, f"{tmp_path}/m", m.version)
        assert (got.shard == m.shard).all() and (got.shards, got.version) == (m.shards, m.version)
    with pytest.raises(Exception, match="exist"):
        second.save(spark, f"{tmp_path}/m", first)
    moved = second.shard != third.shard
    assert moved.any() and set(third.shard[moved].tolist()) == {8}
    load = np.bincount(third.shard, sizes)
    assert load.max() <= 1.1 * load.mean() and load[8] >= 0.9 * load.mean()
    assert (second.shard != first.shard).sum() < 256  # an edit, not a new map


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1)
    placed = {(r.doc_id, r.text_crc32): r.shard for r in sharding.place(df, 4, f"{tmp_path}/map").collect()}
    sharding.write_shards(df, sharding.SlotMap.load(spark, f"{tmp_path}/map"), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 301 and all(placed[r.doc_id, zlib.crc32((r.text or "").encode())] == r.shard and r.lang == "en" for r in got)
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("shard", F.lit(1)), sharding.SlotMap.even(2), f"{tmp_path}/no")


# op13


def runs_by_hand(w, power, least):
    best = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    r = random.Random(5)
    for _ in range(1500):
        n, k, w = r.randint(0, 70), r.choice([1, 2, 2, 3, 4]), []
        base = [r.randrange(k) for _ in range(r.randint(1, 6))]
        while len(w) < n:
            w += base * r.randint(1, 5) if r.random() < 0.4 else [r.randrange(k)]
        for power, least in ((2, 2), (3, 3), (4, 6)):
            assert [tuple(x) for x in repeats.runs(np.array(w[:n]), power, least).tolist()] == runs_by_hand(w[:n], power, least)


def test_previous_factors():
    w = np.array([1, 2, 1, 2, 1, 3, 2, 1, 3, 1])
    length, source = repeats.previous_factors(repeats.ranks(w))
    for i in range(len(w)):
        fits = [next((m for m in range(len(w)) if i + m == len(w) or w[j + m] != w[i + m]), 0) for j in range(i)]
        assert length[i] == max(fits, default=0) and (not length[i] or fits[source[i]] == length[i])


PHRASE = "\x1c a b  c".split(" ")
TEXTS = [
    (1, "a b c " * 9), (2, None), (3, ""), (4, " \t\n "), (5, "x x x x x x"), (6, "x x x x x"), (7, "a A a A a A a A"), (8, "q " + "m n " * 4 + "q " + "m n " * 4), (8, "other"), (8, "other"), (None, "z " * 7),
    (9, "k\x0bk\x0ck k\rk\nk"), (10, " ".join(str(i % 997) for i in range(40_000))), (11, " ".join(["o"] * 30_000)), (12, " ".join(PHRASE * 5)), (13, "a a b a a b a a b a a b a a"),
]


def test_collapsed_texts(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(0)).repartition(3)
    got = sorted(repr((r.doc_id, [tuple(x) for x in r.runs], r.collapsed)) for r in periodic.collapse(df).collect())
    want = []
    for i, t in TEXTS:
        words = [x.decode() for x in (t or "").encode().split()]
        found = [(0, 40_000, 997)] if i == 10 else [(0, 30_000, 1)] if i == 11 else runs_by_hand(words, 4, 6)
        gone = {p for s, n, q in found for p in range(s + q, s + n)}
        want.append(repr((i, found, " ".join(x for p, x in enumerate(words) if p not in gone))))
    assert got == sorted(want)
    assert periodic.digest(periodic.collapse(df.limit(0))).count() == 0
    none = [r for r in periodic.digest(periodic.collapse(df)).collect() if r.doc_id == 2][0]
    assert none.n_runs == 0 and none.start is None and none.exponent_milli is None and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op4_chat", "op8_covertree", "op10_minhash", "op11_lloyd", "op13_periodic"])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[c] for c in names]) for r in rows)
