"""Scalar functions, on the cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from cutgrain.functions import costs, hashing, pictures, text
from cutgrain.operators import sampling


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fnv1a(spark):
    got = one(spark, *[hashing.fnv1a(F.lit(x).cast("binary")) for x in ("", "a", "foobar")])
    assert [int(x) for x in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_words(spark):
    df = spark.createDataFrame([("Aerial view: six barges unload gravel near 2024th street; trains!",), ("Шотландия горы",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.words(F.col("t"))).collect()]
    assert got == [["barg", "unlo", "grav", "2024", "stre", "trai"], ["шотл", "горы"], None, []]


def test_times_and_money(spark):
    L = F.lit
    assert one(spark, text.format_time(L(3725.9)), text.format_time(L(-3.0)), text.format_time(L(65.0))) == ("1:02:05", "0:00", "1:05")
    assert one(spark, text.parse_at(L("1:02:03.5")), text.parse_at(L("90")), text.parse_at(L("x")), text.parse_at(L("1:2:3:4"))) == (3723.5, 90.0, None, None)
    assert one(spark, text.dollars(L(1.5)), text.dollars(L(0.0123)), text.dollars(L(2.0)), text.dollars(L(0.12))) == ("$1.50", "$0.0123", "$2.00", "$0.12")
    assert one(spark, text.parse_cost(L("$2.5")), text.parse_cost(L("0")), text.parse_cost(L("inf"))) == (2.5, None, None)


def test_sizes_and_tokens(spark):
    L = F.lit
    sizes = one(spark, costs.frame_size(L(1920), L(1080)), costs.frame_size(L(1080), L(1920)), costs.frame_size(L(320), L(240)))
    assert [(s.width, s.height) for s in sizes] == [(512, 288), (288, 512), (320, 240)]
    bound = lambda p, w, h: costs.image_tokens_bound(L(p), L(w), L(h))
    assert one(spark, costs.frame_tokens(L(512), L(288)), bound("anthropic", 512, 288), bound("gemini", 512, 288), bound("openai", 512, 288), bound("openai", 1024, 512)) == (209, 209, 280, 255, 830)
    assert one(spark, *[costs.max_segments(L(float(d))) for d in (10, 150, 1800)]) == (3, 5, 12)


def test_fingerprint_diff(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.expr("cast(array() as array<int>)")
    d = pictures.fingerprint_diff
    assert one(spark, d(a(0, 0), a(255, 255)), d(a(100), a(0)), d(a(), a()), d(a(1), a(1, 2))) == (1.0, pytest.approx(100 / 255), 0.0, 0.0)


def test_rotation_and_distance(spark):
    grid = F.array(*[F.lit((i * 37) % 200) for i in range(64)])
    df = spark.range(1).select(grid.alias("g")).select("g", pictures.normalise(F.col("g")).alias("n"))
    r = df.select(pictures.rotate(F.col("g")).alias("r"), pictures.shot_distance(pictures.turns(F.col("n")), pictures.rotate(F.col("n"))).alias("d"), pictures.normalise(F.array(F.lit(5), F.lit(5))).alias("blank")).first()
    g = [(i * 37) % 200 for i in range(64)]
    assert r.r == [g[(7 - i % 8) * 8 + i // 8] for i in range(64)]
    assert abs(r.d) < 1e-9 and r.blank is None


@pytest.mark.parametrize(("duration", "n", "first"), [(1.0, 1, [0.5]), (10.0, 5, [0, 2, 4]), (38.0, 19, [0, 2]), (600.0, 60, [0, 10]), (0.0, 0, [])])
def test_sample_times(spark, duration, n, first):
    got = one(spark, sampling.sample_times(F.lit(duration)))[0]
    assert len(got) == n and got[: len(first)] == first


@pytest.mark.parametrize(("duration", "n"), [(10.0, 20), (0.1, 1), (0.0, 0), (10_000.0, 240)])
def test_candidate_times(spark, duration, n):
    assert len(one(spark, sampling.sample_times(F.lit(duration), *sampling.CANDIDATES))[0]) == n


def test_moment_times(spark):
    assert one(spark, sampling.moment_times(F.lit(0.5), F.lit(1.0), F.lit(10.0)), sampling.moment_times(F.lit(5.0), F.lit(-1.0), F.lit(10.0))) == ([0.0, 0.5, 1.5], [5.0])
