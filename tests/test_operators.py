"""Operators of the footage engine, on the cases of FIXTURES.md."""

import json

import numpy as np
from pyspark.sql import functions as F

from cutgrain.operators import answers, budget, grouping, intervals, keyframes, replies, sampling, shots, stretches
from cutgrain.operators.components import connected_components
from cutgrain.operators.runs import describe_clips, recorded
from cutgrain.sources import subtitles, tables


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (10, 9), (9, 8), (8, 7), (5, 5), (None, 4), (2, 1)], "src long, dst long")
    assert {r.id: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    assert connected_components(e.limit(0)).collect() == []


def test_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(e).collect()} == {0}


def test_key_frames(spark):
    rows = [(1, i, 1.0 if i == 5 else 0.0) for i in range(8)] + [(2, i, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "clip_id int, idx int, score double")
    pick = lambda clip, m: sorted(r.idx for r in keyframes.select_key_frames(df.where(f"clip_id = {clip}"), F.lit(m)).collect())
    assert pick(1, 2) == [0, 5] and pick(2, 3) == [0, 3, 6] and pick(2, 20) == list(range(9)) and pick(1, 0) == []


def test_shot_times(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 3.0), (1, 2, 4.0, 6.0), (2, 0, 0.0, 20.0), (2, 1, 20.0, 30.0)] + [(3, i, float(i), i + 0.5 + i / 100) for i in range(70)], "clip_id int, pos int, start_s double, end_s double")
    t = lambda c, n: sorted(r.time_s for r in sampling.shot_times(s.where(f"clip_id = {c}"), F.lit(n)).collect())
    assert t(1, 3) == [1.0, 2.5, 5.0]
    assert len(t(2, 15)) == 15 and len(t(3, 60)) == 60 and min(t(3, 60)) > 10


def test_merge_and_coverage(spark):
    i = spark.createDataFrame([(1, 0, 0.0, 3.0, "A tram"), (1, 1, 3.0, 6.0, " a TRAM "), (1, 2, 6.0, 9.0, "a tram"), (1, 3, 9.0, 10.0, "cat")], "clip_id int, pos int, start_s double, end_s double, description string")
    got = [tuple(r)[2:] for r in intervals.merge_neighbours(i).orderBy("pos").collect()]
    assert got == [(0.0, 9.0, "A tram"), (9.0, 10.0, "cat")]
    assert intervals.covered(i, ["clip_id"], F.lit(1.0), F.lit(9.5)).first().covered_s == 8.5


def test_nearby_cues(spark):
    c = spark.createDataFrame([(1, 9500, 10400, "in"), (1, 1000, 2000, "out"), (1, 7500, 8000, "wide")], "clip_id int, start_ms long, end_ms long, text string")
    for width, want in ((1000, {"in"}), (3000, {"in", "wide"}), (-5, {"in"})):
        m = spark.createDataFrame([(1, 0, 10000, width)], "clip_id int, moment_id int, at_ms long, width_ms long")
        assert {r.text for r in intervals.nearby_cues(c, m).collect()} == want


def parsed(spark, body, duration=37.0, stop="end_turn", important=True):
    df = spark.createDataFrame([(1, duration, json.dumps(body) if not isinstance(body, str) else body, stop)], "clip_id int, duration_s double, body string, stop_reason string")
    return answers.parse_answers(df, important).first()


def seg(a, b, d="x"):
    return {"start_s": a, "end_s": b, "description": d}


def test_parse_answer(spark):
    r = parsed(spark, {"summary": " s ", "segments": [seg(20, 99, "late"), seg(-1, 3), seg(31.5, 40, "past"), seg(2, 5, "  "), seg("3", 9), 7, seg(1, 4, " early ")]}, 30.0)
    assert r.error is None and r.summary == "s" and [tuple(s) for s in r.segments] == [(1.0, 4.0, "early"), (20.0, 30.0, "late")]


def test_parse_answer_tiling(spark):
    tiles = [seg(0, 12, "a"), seg(12, 25, "b"), seg(25, 37, "c")]
    assert parsed(spark, {"summary": "s", "segments": tiles}).segments == []
    assert len(parsed(spark, {"summary": "s", "segments": tiles, "distinct_parts": True}).segments) == 3
    r = parsed(spark, {"summary": "s", "segments": tiles, "distinct_parts": True, "main": [{"start_s": 3, "end_s": 10}]})
    assert r.segments == [] and tuple(r.main) == (3.0, 10.0)


def test_parse_answer_limits(spark):
    assert parsed(spark, {"summary": "s", "segments": [seg(0, 27)]}, 30.0).segments == []
    assert len(parsed(spark, {"summary": "s", "segments": [seg(0, 26.9)]}, 30.0).segments) == 1
    assert parsed(spark, {"summary": "s", "segments": [seg(0, 14, "a"), seg(14, 28, "A ")]}, 30.0).segments == []
    long_ = "a lorry waits by the depot"
    r = parsed(spark, {"summary": f"Here {long_} quietly. A tram too", "segments": [seg(1, 2, long_), seg(3, 4, "A tram")]})
    assert [s.description for s in r.segments] == ["A tram"]
    assert len(parsed(spark, {"summary": "s", "segments": [seg(i, i + 0.5, str(i)) for i in range(9)]}).segments) == 3


def test_parse_answer_main_and_errors(spark):
    for given, want in (([20, 50], (20.0, 37.0)), ([0, 34], None), ([0, 33], (0.0, 33.0)), ([-4, 5], (0.0, 5.0)), ([40, 45], None), ([9, 9], None)):
        r = parsed(spark, {"summary": "s", "segments": [], "main": [{"start_s": given[0], "end_s": given[1]}]})
        assert (r.main and tuple(r.main)) == want
    assert parsed(spark, {"summary": " "}).error == "The answer had no summary"
    assert parsed(spark, "not json").error == "The answer had no summary"
    assert parsed(spark, {"summary": "s"}, stop="refusal").error == "The model declined to describe it"


def test_tags(spark):
    body = {"tags": [{"name": "Sheep", "confidence": 1.5, "ranges": []}, {"name": "Sheep", "confidence": 0.2, "ranges": []}, {"name": "Car", "confidence": 0.5, "ranges": []}, {"name": "Kitchen", "confidence": "x", "ranges": []}, {"name": "Kitchen", "confidence": 0.5, "ranges": []}, {"name": "Dawn", "confidence": 0.5, "ranges": [{"start_s": 90, "end_s": 95}]}], "new_tag_ideas": ["Barn", "  ", 3, "Barn"]}
    df = spark.createDataFrame([(1, 30.0, json.dumps(body))], "clip_id int, duration_s double, body string")
    v = spark.createDataFrame([("Sheep",), ("Kitchen",), ("Dawn",)], "name string")
    assert [(r.name, r.confidence) for r in answers.parse_tags(df, v).collect()] == [("Sheep", 1.0)]
    assert answers.parse_new_tag_ideas(df).first().ideas == ["Barn", "Barn"]


def test_envelopes(spark):
    part = lambda t, **more: {"text": t, **more}
    gem = lambda reason, *parts: {"candidates": [{"content": {"parts": list(parts)}, **({"finishReason": reason} if reason else {})}], "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 1, "thoughtsTokenCount": 9}}
    cases = [
        ("anthropic", {"content": [{"type": "text", "text": '{"a":'}, {"type": "thinking", "text": "hm"}, {"type": "text", "text": "1}"}], "stop_reason": "end_turn", "usage": {"input_tokens": 5, "output_tokens": 2}}, ('{"a":1}', "end_turn", 5, 2, None)),
        ("anthropic", {"content": [], "usage": {"input_tokens": -1, "output_tokens": 1.5}}, ("", "", 0, 0, None)),
        ("anthropic", {"content": [{"type": "text", "text": "null"}], "stop_reason": "end_turn"}, ("null", "end_turn", 0, 0, "bad_answer")),
        ("openai", {"choices": [{"message": {"content": "oops"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}, ("oops", "end_turn", 3, 4, "bad_answer")),
        ("openai", {"choices": [{"message": {"refusal": "no"}, "finish_reason": "stop"}]}, (None, "refusal", 0, 0, None)),
        ("openai", {"choices": [{"message": {"refusal": "", "content": "{"}, "finish_reason": "length"}]}, ("{", "max_tokens", 0, 0, None)),
        ("gemini", gem("MAX_TOKENS", part("{}")), ("{}", "max_tokens", 7, 10, None)),
        ("gemini", gem(None, part("hm", thought=True), part("{"), part("}")), ("{}", "end_turn", 7, 10, None)),
        ("gemini", gem("IMAGE_SAFETY"), ("", "refusal", 7, 10, None)),
        ("gemini", {"promptFeedback": {"blockReason": "OTHER"}}, (None, "refusal", 0, 0, None)),
        ("gemini", {"candidates": []}, ("", "", 0, 0, "bad_answer")),
    ]
    rows = [(i, p, json.dumps(raw)) for i, (p, raw, _) in enumerate(cases)] + [(99, "openai", "not json")]
    got = {r[0]: tuple(r[1:]) for r in replies.read_envelopes(spark.createDataFrame(rows, "clip_id int, provider string, raw string")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == want, i
    assert got[99] == ("", "", 0, 0, None)


def test_statuses(spark):
    err = lambda m=None, **more: json.dumps({"error": ({"message": m} if m else {}) | more})
    cases = [
        ("anthropic", 200, "{}", "answer"), ("openai", 401, "", "key_rejected"), ("gemini", 403, "", "key_rejected"), ("anthropic", 402, "", "out_of_credit"), ("openai", 402, "", "rejected"),
        ("anthropic", 400, err("Your CREDIT balance is too low"), "out_of_credit"), ("openai", 400, err("credit balance"), "rejected"), ("anthropic", 400, err("monthly Spending Limit"), "limit_reached"),
        ("openai", 429, err("x", code="insufficient_quota"), "out_of_credit"), ("openai", 429, err("x", code="other"), "rate_limited"), ("anthropic", 429, err("x", code="insufficient_quota"), "rate_limited"),
        ("gemini", 400, err("x", details=[{"a": 1}, {"reason": "API_KEY_INVALID"}]), "key_rejected"), ("gemini", 400, err("API key expired"), "key_rejected"), ("gemini", 400, err("api key not valid"), "rejected"),
        ("gemini", 429, err("Prepayment is used up"), "out_of_credit"), ("gemini", 429, err("your credits are depleted"), "out_of_credit"), ("gemini", 429, err("check billing"), "rate_limited"),
        ("anthropic", 529, "", "retry"), ("openai", 529, "", "rejected"), ("anthropic", 504, "", "rejected"), ("gemini", 504, "", "retry"), ("openai", 502, "", "retry"), ("gemini", 408, "", "rejected"), ("openai", 413, "", "rejected"),
    ]
    rows = [(i, p, s, raw, None) for i, (p, s, raw, _) in enumerate(cases)]
    rows += [(100, "gemini", 429, err("x", details=[{"retryDelay": "bad"}, {"retryDelay": "0.5s"}]), 3.0), (101, "openai", 429, "", 3.0), (102, "gemini", 429, "", None)]
    got = {r.i: r for r in replies.classify(spark.createDataFrame(rows, "i int, provider string, status int, raw string, retry_after_s double")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert got[i].outcome == want, cases[i]
        assert (got[i].stops_run is not None) == (want in replies.STOPS_RUN)
    assert [got[i].wait_s for i in (100, 101, 102)] == [1.0, 3.0, 20.0]
    assert got[1].reason == "OpenAI rejected the key" and got[7].stops_run == "Stopped: monthly Spending Limit" and got[4].reason == "HTTP 402" and got[0].reason is None


def test_combined_and_tags_only(spark):
    body = json.dumps({"summary": "a field", "segments": [], "tags": [{"name": "Sky", "confidence": 0.5, "ranges": []}], "new_tag_ideas": ["Cloud"]})
    df = spark.createDataFrame([(1, 30.0, body, "end_turn"), (2, 30.0, body, "refusal"), (3, 30.0, "{}", "end_turn"), (4, 30.0, None, "x")], "clip_id int, duration_s double, body string, stop_reason string")
    v = spark.createDataFrame([("Sky",)], "name string")
    tags = {r.clip_id: r for r in answers.parse_tags_only(df, v).collect()}
    assert [x.name for x in tags[1].tags] == ["Sky"] and tags[1].ideas == ["Cloud"] and tags[3].tags == [] and tags[3].error is None
    assert (tags[2].error, tags[2].tags, tags[4].error) == ("The model declined to suggest tags", None, "The model stopped early (x)")
    both = {r.clip_id: r for r in answers.parse_combined(df, v).collect()}
    assert both[1].summary == "a field" and both[1].ideas == ["Cloud"] and both[3].error == "The answer had no summary" and both[3].tags is None


def test_budget(spark):
    rows = [(1, 0, 60, 10), (1, 1, 90, 90), (1, 2, 1, 1), (1, 3, 1, 1)]
    df = spark.createDataFrame(rows, "k int, i int, bound long, actual long")
    assert [r.outcome for r in budget.serial_budget(df, F.lit(100), ["k"], ["i"]).orderBy("i").collect()] == ["admitted", "admitted", "stopped", "not_started"]


def test_srt(spark):
    t = "﻿1\r\n00:00:05,000 --> 00:00:06,500 X1:40\r\n later\r\n\r\n2\r\nnot a time\r\n\r\n00:00:01.5 --> 00:00:02\r\nfirst\nline\r\n\r\n3\r\n00:00:09,000 --> 00:00:08,000\r\nbackwards\r\n"
    got = subtitles.parse_srt(spark.createDataFrame([(1, t)], "clip_id int, text string")).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1005, 2000, "first\nline"), (5000, 6500, "later")]


def test_ass(spark):
    t = "[Script Info]\nDialogue: 0,0:00:00.0,0:00:09.0,nope\n[Events]\nFormat: Start, End, Text,\nDialogue: 0:00:03.5,0:00:04.25,{\\i1}Hi{\\i0}, all\\Nof\\hyou\nDialogue: 0:00:01.0,0:00:02.0,{\\p1}m 0 0 l 1{\\p0}drawn\nDialogue: broken\nDialogue: 99999999999999:00:01.0,0:00:02.0,absurd"
    got = subtitles.parse_ass(spark.createDataFrame([(1, t)], "clip_id int, text string")).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1000, 2000, "drawn"), (3500, 4250, "Hi, all\nof you")]
    assert subtitles.plain_text("{" * 200_000) == "{" * 200_000


def test_vocabulary(spark):
    v = spark.createDataFrame([(1, "Sheep — hint\nKitchen\n# c\n\n Dawn - after dark\nX — ")], "file_id int, text string")
    assert [(r.name, r.hint) for r in tables.parse_vocabulary(v).orderBy("pos").collect()] == [("Sheep", "hint"), ("Kitchen", None), ("Dawn", "after dark"), ("X —", None)]


def test_listing_and_identity(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "notes.txt", "a.srt"):
        (tmp_path / name).write_bytes(b"foobar")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner/c.mp4").write_bytes(b"x")
    got = tables.find_videos(spark, f"file://{tmp_path}")
    assert [r.path.rpartition("/")[2] for r in got.collect()] == ["a.mov", "b.MP4"]
    assert {int(r.sample_hash) for r in tables.file_identities(got).collect()} == {0x85944171F73967E8}


def film(*parts):
    return np.concatenate([np.repeat(p[None], n, 0) if p.ndim == 1 else p for p, n in parts])


def shots_of(frames, fps=30.0):
    return shots.transitions(frames, np.arange(len(frames)) / fps)


def test_shots():
    r = np.random.default_rng(1)
    a, b, c = r.integers(0, 256, (3, 64 * 36))
    assert shots_of(film((a, 120))) == []
    assert [x[:2] for x in shots_of(film((a, 60), (b, 45), (c, 40)))] == [(60, 60), (105, 105)]
    assert shots_of(film((a, 60), (b, 2), (a, 60))) == []  # a flash
    ramp = np.linspace(0, 1, 31)[1:-1, None]
    mixed = (a * (1 - ramp) + b * ramp).astype(int)
    assert [x[2] for x in shots_of(film((a, 60), (mixed, 0), (b, 60)))] == ["dissolve"]
    dark = (a * (1 - ramp)).astype(int)
    assert [x[2] for x in shots_of(film((a, 60), (dark, 0), (np.zeros(64 * 36, int), 60)))] == ["fade"]
    assert shots_of(film((a, 5), (b, 60))) == []  # too early


def test_the_longest_film_fits(spark):
    """Half an hour at 30 frames a second: cuts, a dissolve, a flash and noise, in bounded memory."""
    import tracemalloc

    r = np.random.default_rng(4)
    stills = r.integers(0, 255, (5, 64 * 36), np.uint8)
    frames = np.repeat(stills, 10_800, 0)
    frames[::7] += 1  # a little noise
    ramp = np.linspace(0, 1, 42)[1:-1, None]
    frames[21_580:21_620] = stills[1] * (1 - ramp) + stills[2] * ramp
    frames[40_000:40_002] = stills[0]
    tracemalloc.start()
    found = shots_of(frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and frames.nbytes < 130e6
    assert [(a, k) for a, _, k in found if k == "cut"] == [(10_800, "cut"), (32_400, "cut"), (43_200, "cut")]
    assert [(abs(a - 21_580) < 10, abs(z - 21_620) < 3, k) for a, z, k in found if k != "cut"] == [(True, True, "dissolve")]
    few = np.concatenate([frames[10_700:10_900]])
    rows = [(1, i, i / 30, bytearray(x.tobytes()), x.tolist()) for i, x in enumerate(few)]
    df = spark.createDataFrame(rows, "clip_id long, idx int, time_s double, px binary, ints array<int>")
    clips = spark.createDataFrame([(1, 6.0)], "clip_id long, duration_s double")
    got = [shots.find_shots(df.select("clip_id", "idx", "time_s", F.col(c).alias("px")), clips).orderBy("pos").collect() for c in ("px", "ints")]
    assert got[0] == got[1] and len(got[0]) == 2


def test_stretches_partition_the_clip(spark):
    r = np.random.default_rng(2)
    a, b = (r.integers(0, 256, 64).tolist() for _ in range(2))
    rows = [(1, 2.0 * i, a if i < 3 else b) for i in range(6)] + [(2, 0.0, [7] * 64)]
    f = spark.createDataFrame(rows, "clip_id long, time_s double, fp array<int>")
    clips = spark.createDataFrame([(1, 12.0), (2, 5.0), (3, 4.0)], "clip_id long, duration_s double")
    got = {(x.clip_id, x.pos): (x.start_s, x.end_s, x.signature is None) for x in stretches.stretches_of(f, clips).collect()}
    assert got == {(1, 0): (0.0, 5.0, False), (1, 1): (5.0, 12.0, False), (2, 0): (0.0, 5.0, True), (3, 0): (0.0, 4.0, True)}


def test_grouping(spark):
    r = np.random.default_rng(3)
    norm = lambda g: ((g - g.mean()) / g.std()).tolist()
    a, b, c = r.integers(0, 256, (3, 64)).astype(float)
    turned = np.rot90(a.reshape(8, 8), -1).reshape(-1) * 0.9 + 5
    s = spark.createDataFrame([(1, 0, 0.0, 9.0, norm(a)), (2, 0, 0.0, 9.0, norm(turned)), (3, 0, 0.0, 9.0, norm(b)), (4, 0, 0.0, 9.0, norm(c)), (5, 0, 0.0, 9.0, None)], "clip_id long, pos long, start_s double, end_s double, signature array<double>")
    words = ["lorries crossing bridges", "tractors ploughing fields", "boats sailing harbour water", "boats sailing harbour sunset", "boats sailing harbour"]
    summaries = spark.createDataFrame([(i + 1, w) for i, w in enumerate(words)], "clip_id long, summary string")
    none = spark.createDataFrame([], "clip_id long, item int, start_s double, end_s double, description string")
    for on, want in ((True, [1, 1, 2, 2, 3]), (False, [1, 1, 2, 3, 4])):
        got = grouping.group_clips(s, none, summaries, use_words=on)
        assert [x.group_id for x in got["clips"].orderBy("clip_id").collect()] == want
    assert got["groups"].where("group_id = 1").first().label == words[0]


def test_run(spark):
    clips = spark.createDataFrame([(1, 30.0, "a", "s"), (2, 30.0, "b", "s"), (3, 9999.0, "c", "s"), (4, 30.0, "d", "s"), (5, 30.0, "e", "s")], "clip_id long, duration_s double, identity string, settings string")
    cache = spark.createDataFrame([("a", "s", ("before",))], "identity string, settings string, clip struct<summary:string>")
    empty = "cast(array() as array<struct<start_s:double,end_s:double,description:string>>)"
    cache = cache.withColumn("clip", F.struct("clip.summary", F.expr(empty).alias("segments"), F.expr("cast(null as struct<start_s:double,end_s:double>)").alias("main")))
    rec = spark.createDataFrame([(1, '{"summary": "x"}', "end_turn"), (2, '{"summary": "x"}', "end_turn"), (4, "{}", "refusal")], "clip_id long, body string, stop_reason string")
    run = describe_clips(clips, cache, recorded(rec)).collect()
    got = {r.clip_id: r.outcome for r in run}
    assert {r.clip_id: r.summary for r in run if r.summary} == {1: "before", 2: "x"}
    assert got == {1: "cached", 2: "described", 3: "too_long", 4: "failed", 5: "not_started"}
    assert {r.clip_id: r.outcome for r in describe_clips(clips, cache, recorded(rec), force=True).collect()}[1] == "described"


def test_every_line_is_a_segment(spark, sf):
    from cutgrain.plans import fixtures, registry

    clips = {r.clip_id for r in fixtures.clip_list(spark, sf).collect()}
    want = {(r.doc_id, i, line) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in clips for i, line in enumerate((r.text or "").split("\n")[1:])}
    got = registry._line_segments(spark, sf).collect()
    assert {(r.clip_id, r.item, r.description) for r in got} == want and len(got) == len(want) and max(r.item for r in got) > 2
    assert all(0 <= r.start_s < r.end_s <= 20.0001 for r in got)


def test_linked_orders_of_all(spark, sf):
    from cutgrain.plans import registry

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect():
        lo, hi = sorted((root(r.l_orderkey), root(r.l_suppkey + 1_000_000_000)))
        up[hi] = lo
    got = registry.queries()["linked_orders"](spark, sf).collect()
    assert {r.id: r.component for r in got} == {x: root(x) for x in list(up)} and len(got) == len(up)


def test_every_clip_has_shots(spark, sf):
    from cutgrain.plans import fixtures, registry

    got = registry.queries()["shots"](spark, sf).collect()
    assert {r.clip_id for r in got} == {r.clip_id for r in fixtures.clip_list(spark, sf).collect()}
    assert sorted((r.start_s, r.end_s) for r in got if r.clip_id == 7) == [(0.0, 2.0), (2.0, 4.0)]


def test_every_part_is_hashed(spark, sf):
    from cutgrain.plans import registry

    def by_hand(name):
        h = 0xCBF29CE484222325
        for b in name.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return str(h)

    names = {r[0] for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()}
    names |= {f"part {r.p_partkey}" for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    got = registry.queries()["fnv_hash"](spark, sf).collect()
    assert {r.name: r.hash for r in got} == {n: by_hand(n) for n in names} and len(got) == len(names)
