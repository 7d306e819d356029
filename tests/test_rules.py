"""Rules that no registered query reaches, each against plain Python."""

import itertools
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutgrain.functions import costs, pictures
from cutgrain.operators import answers, budget, intervals, requests
from cutgrain.operators.runs import describe_clips, recorded
from cutgrain.sources import subtitles, tables


def test_overlaps_of_all_lengths(spark):
    r = random.Random(4)

    def spans(n, base):
        out = []
        for i in range(n):
            lo = r.choice([r.uniform(-50, 50), float(r.randrange(-20, 20))])
            out.append((r.randrange(3) if r.random() < 0.5 else 7, base + i, lo, lo + r.choice([0.0, r.uniform(0, 1), r.uniform(0, 200), 2.0, 64.0, -1.0])))
        return out

    a, b = spans(120, 0), spans(90, 1000)
    want = sorted((x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    da = spark.createDataFrame(a, "k long, i long, lo double, hi double").withColumn("level", F.lit("x"))
    db = spark.createDataFrame(b, "k long, j long, start double, end double")
    got = intervals.overlap_join(da, db, ["k"], ("lo", "hi"), ("start", "end"))
    assert sorted((x.i, x.j) for x in got.collect()) == want
    assert intervals.overlap_join(da.limit(0), db, ["k"], ("lo", "hi"), ("start", "end")).count() == 0


def test_nearest_shots(spark):
    r = random.Random(5)
    shots, frames = [], []
    for clip in range(6):
        at = 0.0
        for pos in range(r.randrange(0, 6)):
            at += r.choice([0.0, 1.0, 2.5])
            shots.append((clip, pos, at, at + r.choice([1.0, 3.0])))
            at = shots[-1][3]
        frames += [(clip, float(r.randrange(0, 40)) / 2, i) for i in range(12)]
    want = {}
    for clip, t, i in frames:
        own = [(max(s - t, t - e, 0.0), pos) for c, pos, s, e in shots if c == clip]
        want[clip, i] = min(own)[1] if own else None
    f = spark.createDataFrame(frames, "clip_id long, time_s double, i long").withColumn("kind", F.lit("x"))
    got = intervals.nearest_shot(f, spark.createDataFrame(shots, "clip_id long, pos long, start_s double, end_s double")).collect()
    assert {(x.clip_id, x.i): x.pos for x in got} == want and len(got) == len(frames) and got[0].kind == "x"


@pytest.mark.parametrize(("w", "h"), [(64, 36), (10, 9), (8, 8), (5, 3), (1, 1), (33, 70)])
def test_fingerprint(spark, w, h):
    img = np.random.default_rng(w).integers(0, 256, (h, w, 3), np.uint8)
    want = []
    for gy, gx in itertools.product(range(8), range(8)):
        x0, y0 = gx * w // 8, gy * h // 8
        cell = img[y0 : min(max((gy + 1) * h // 8, y0 + 1), h), x0 : min(max((gx + 1) * w // 8, x0 + 1), w)].reshape(-1, 3).astype(int)
        want.append(int((cell @ [299, 587, 114]).sum()) // len(cell) // 1000)
    df = spark.createDataFrame([(bytearray(img.tobytes()), w, h), (None, w, h), (bytearray(b"\x01"), w, h), (bytearray(b""), 0, 0)], "px binary, w int, h int")
    assert [r[0] for r in df.select(pictures.fingerprint("px", "w", "h")).collect()] == [want, None, None, None]


def test_jpeg_size(spark):
    part = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    frame = lambda kind, w, h: part(kind, struct.pack(">BHHB", 8, h, w, 3) + bytes(9))
    good = b"\xff\xd8" + part(0xE0, b"JFIF" + bytes(10)) + part(0xC4, bytes(20)) + b"\xff" + frame(0xC2, 640, 480) + b"rest"
    cases = [(good, (640, 480)), (b"\xff\xd8" + frame(0xC0, 7, 5), (7, 5)), (b"\xff\xd8" + b"\xff\xd0" + frame(0xC1, 1, 2), (1, 2)), (b"\x89PNG" + bytes(40), (None, None)), (good[:12], (None, None)), (b"", (None, None)), (None, (None, None)), (b"\xff\xd8" + part(0xE0, b"x") + b"oops" + bytes(20), (None, None))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [tuple(r.s) for r in df.select("i", tables.jpeg_size("b").alias("s")).orderBy("i").collect()] == [want for _, want in cases]


def test_sidecars(spark):
    videos = spark.createDataFrame([("/a/x.mp4",), ("/a/y.MOV",), ("/a/z.mp4",), ("/b.dir/noext",)], "path string")
    files = spark.createDataFrame([("/a/x.ssa", "s"), ("/a/x.ass", "a"), ("/a/y.SRT", "other"), ("/a/y.ssa", "y"), ("/c/z.ass", "elsewhere"), ("/b.dir/noext.ass", "n")], "path string, text string")
    got = {r.path: r.subtitles for r in subtitles.sidecars(videos, files, ("ass", "ssa")).collect()}
    assert got == {"/a/x.mp4": "a", "/a/y.MOV": "y", "/a/z.mp4": None, "/b.dir/noext": "n"}


def test_bounds_and_timeouts(spark):
    rows = [(1, "text", 3500, None, None), (1, "image", None, 512, 288), (1, "image", None, 512, 288)]
    model = costs.MODELS[3][0]
    df = spark.createDataFrame([(c, model, k, o, w, h) for c, k, o, w, h in rows], "clip_id long, model string, kind string, octets long, width int, height int")
    got = costs.request_cost_bound(df, 700).first()
    p = costs.priced(df).first()
    images = spark.range(1).select(costs.image_tokens_bound(F.lit(p.provider), F.lit(512), F.lit(288)).alias("n")).first().n
    tokens = -(-(3500 / 3.5 + 2 * images + 700 / 3.5 + 500) * 1.1 // 1)
    assert got.bound_usd == pytest.approx((tokens * p.input_usd_per_mtok + p.max_answer_tokens * p.output_usd_per_mtok) / 1e6)
    assert spark.range(1).select(costs.timeout_s(F.lit(60.0), F.lit(1_000_000))).first()[0] == 80.0


def test_notes_and_charges(spark):
    df = spark.createDataFrame([("x" * 2000,), (" " + "x" * 2000 + "\n",), ("é" * 2001,), (None,)], "n string")
    got = [r[0] for r in df.select(requests.check_notes(F.col("n"))).collect()]
    assert [g is None for g in got] == [True, True, False, True] and "2001" in got[2]
    kinds = [(None, 1.0), ("bad_answer", 1.0), ("timeout", 5.0), ("unreadable", 5.0), ("overloaded", 0.0)]
    df = spark.createDataFrame([(k,) for k, _ in kinds], "k string")
    assert [r[0] for r in df.select(budget.charge(F.col("k"), F.lit(5.0), F.lit(1.0))).collect()] == [c for _, c in kinds]


def test_served_after_a_stop(spark):
    df = spark.createDataFrame([("admitted", True), ("stopped", True), ("stopped", False), ("not_started", True), ("not_started", False)], "outcome string, cached boolean")
    assert [r.outcome for r in budget.serve_after_stop(df).collect()] == ["admitted", "cached", "stopped", "cached", "not_started"]


def test_moment_answers(spark):
    rows = [(1, json.dumps({"name": " Kick-off ", "description": "It starts. "}), "end_turn"), (2, json.dumps({"name": " ", "description": "x"}), "end_turn"), (3, json.dumps({"name": 5, "description": "x"}), "end_turn"), (4, "{}", "max_tokens"), (5, "nonsense", "end_turn"), (1, json.dumps({"name": "b", "description": "c"}), "end_turn")]
    got = [tuple(r) for r in answers.parse_moments(spark.createDataFrame(rows, "clip_id long, body string, stop_reason string")).collect()]
    none = "The answer had no name or no description"
    assert got == [(1, None, "Kick-off", "It starts."), (2, none, None, None), (3, none, None, None), (4, "The answer was too long", None, None), (5, none, None, None), (1, None, "b", "c")]


def test_ranges_keep_the_answers_order_and_clips_may_repeat(spark):
    ranges = [(5, 6), (1, 9), (1, 3), (0, 2), (1, 8), (9, 7)]
    body = json.dumps({"tags": [{"name": "Tram", "confidence": 0.5, "ranges": [{"start_s": a, "end_s": b} for a, b in ranges]}, {"name": "tram", "confidence": 1, "ranges": []}], "new_tag_ideas": ["x"], "summary": "s", "segments": []})
    df = spark.createDataFrame([(1, 8.5, body, "end_turn"), (1, 8.5, body, "end_turn"), (1, 8.5, "{}", "end_turn")], "clip_id int, duration_s double, body string, stop_reason string")
    v = spark.createDataFrame([("Tram",), (None,)], "name string")
    got = answers.parse_tags(df, v).collect()
    assert len(got) == 2 and all([tuple(x) for x in r.ranges] == [(0.0, 2.0), (1.0, 8.5), (1.0, 3.0), (1.0, 8.0), (5.0, 6.0)] for r in got)
    assert [len(r.tags) for r in answers.parse_tags_only(df, v).collect()] == [1, 1, 0]
    assert [(r.error is None, r.tags and len(r.tags), r.ideas) for r in answers.parse_combined(df, v).collect()] == [(True, 1, ["x"]), (True, 1, ["x"]), (False, None, None)]


def test_a_cached_clip_is_served_whatever_its_length(spark):
    clips = spark.createDataFrame([(1, 9999.0, "a", "s"), (2, 9999.0, "b", "s")], "clip_id long, duration_s double, identity string, settings string")
    empty = "cast(array() as array<struct<start_s:double,end_s:double,description:string>>)"
    known = spark.createDataFrame([("a", "s")], "identity string, settings string").withColumn("clip", F.struct(F.lit("known").alias("summary"), F.expr(empty).alias("segments"), F.expr("cast(null as struct<start_s:double,end_s:double>)").alias("main")))
    rec = recorded(spark.createDataFrame([], "clip_id long, body string, stop_reason string"))
    assert {r.clip_id: r.outcome for r in describe_clips(clips, known, rec).collect()} == {1: "cached", 2: "too_long"}
    assert {r.clip_id: r.outcome for r in describe_clips(clips, known, rec, force=True).collect()} == {1: "too_long", 2: "too_long"}


def test_estimate_of_retagging(spark):
    model = costs.MODELS[3][0]
    df = spark.createDataFrame([(1, model, 70, "é" * 5, [("abc",), ("de",)])], "clip_id long, model string, subtitle_bytes long, summary string, segments array<struct<description:string>>")
    tags = [("Tram", "on rails"), ("Fog", None)]
    size, n = costs.vocabulary_size(tags)
    r, p = costs.estimate_retagging(df, tags).first(), costs.priced(df).first()
    said = 10 + (3 + 20) + (2 + 20)
    assert r.output_tokens == n * 15 + 100 and r.input_tokens == int((70 + said) / 3.5) + 600 + int(size / 3.5)
    assert r.usd == pytest.approx((r.input_tokens * p.input_usd_per_mtok + r.output_tokens * p.output_usd_per_mtok) / 1e6)
