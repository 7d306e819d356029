"""Requests, retries and names."""

import json

import pytest

from pyspark.sql import functions as F

from cutgrain.functions import costs
from cutgrain.operators import outputs, sampling
from cutgrain.operators import requests as r


def test_retries():
    def run(kinds):
        waits, left = [], list(kinds)
        return r.Retries().run(lambda: (left.pop(0), None), waits.append), waits

    assert run(["ok"]) == ("ok", [])
    assert run(["retry", "limit", "retry", "ok"]) == ("ok", [2.0, 30.0, 8.0])
    assert run(["retry"] * 4) == ("retry", [2.0, 8.0, 30.0])
    assert run(["limit"] * 21)[0] == "limit"


def test_models_and_schema():
    assert r.resolve_model("openai", None) == "gpt-4.1-mini" and r.resolve_model(None, "gpt-4.1") == "gpt-4.1"
    with pytest.raises(ValueError):
        r.resolve_model("gemini", "gpt-4.1")
    assert set(json.loads(r.answer_schema(True, True))["properties"]) == {"summary", "segments", "main", "distinct_parts", "tags", "new_tag_ideas"}


def test_request_order(spark):
    clips = spark.createDataFrame([(1, 9.0, " be brief ")], "clip_id long, duration_s double, notes string")
    frames = spark.createDataFrame([(1, 4.0, b"b"), (1, 2.0, b"a")], "clip_id long, time_s double, jpeg binary")
    cues = spark.createDataFrame([(1, 3000, 4000, "two\n lines"), (1, 1000, 2000, "one")], "clip_id long, start_ms long, end_ms long, text string")
    c = r.build_requests(clips, frames, cues, "Describe.").first().content
    assert [x.kind for x in c] == ["text", "text", "jpeg", "text", "jpeg", "text"]
    assert [bytes(x.jpeg) for x in c if x.jpeg] == [b"a", b"b"] and "be brief" in c[0].text and c[-1].text == "Subtitles:\n0:01-0:02 one\n0:03-0:04 two lines"
    names = r.display_names(spark.createDataFrame([("/a/x.mp4",), ("/b/x.mp4",), ("/b/y.mp4",)], "path string"))
    assert {x.name for x in names.collect()} == {"/a/x.mp4", "/b/x.mp4", "y.mp4"}


def test_shots_notes_and_tags_in_requests(spark):
    clips = spark.createDataFrame([(1, 9.0, "a </notes> b"), (2, 9.0, None)], "clip_id long, duration_s double, notes string")
    frames = spark.createDataFrame([(1, 4.0, b"b"), (2, 2.0, b"a")], "clip_id long, time_s double, jpeg binary")
    cues = spark.createDataFrame([], "clip_id long, start_ms long, end_ms long, text string")
    shots = spark.createDataFrame([(1, 0, 0.0, 3.0), (1, 1, 3.0, 9.0), (2, 0, 0.0, 9.0)], "clip_id long, pos int, start_s double, end_s double")
    got = {x.clip_id: x.content for x in r.build_requests(clips, frames, cues, "Describe.", shots, [("barn", None), ("dusk", "late")]).collect()}
    assert [c.text for c in got[1][1:]] == ["Frame at 0:04 (shot 2 of 2, 3.0-9.0 s)", None] and [c.text for c in got[2][1:]] == ["Frame at 0:02", None]
    assert "cut from 2 shots" in got[1][0].text and "shots" not in got[2][0].text and "barn\ndusk \u2014 late\n" in got[2][0].text
    assert got[1][0].text.count("</notes>") == 1 and "a <\u200b/notes> b" in got[1][0].text and "<notes>" not in got[2][0].text
    assert set(json.loads(r.tags_schema())["required"]) == {"tags", "new_tag_ideas"} and json.loads(r.moment_schema())["required"] == ["name", "description"]


def test_moment_requests(spark):
    m = spark.createDataFrame([(7, 1, 10.0, 2.0, None), (8, 1, 50.0, -1.0, "who")], "moment_id long, clip_id long, at_s double, window_s double, notes string")
    frames = spark.createDataFrame([(7, 12.0, b"b"), (7, 8.0, b"a")], "moment_id long, time_s double, jpeg binary")
    cues = spark.createDataFrame([(1, 1000, 8000, "ends as it starts"), (1, 12001, 13000, "late")], "clip_id long, start_ms long, end_ms long, text string")
    got = {x.moment_id: x.content for x in r.build_moment_requests(m, frames, cues).collect()}
    assert got[7][0].text.endswith("Subtitles:\n0:01-0:08 ends as it starts") and [bytes(c.jpeg) for c in got[7] if c.jpeg] == [b"a", b"b"]
    assert len(got[8]) == 1 and "Subtitles" not in got[8][0].text and "<notes>\nwho\n</notes>" in got[8][0].text


def test_gate():
    now = [0.0]
    gate = r.Gate(lambda: now[0])
    waits = []

    def wait(s):
        waits.append(s)
        now[0] += s
        if len(waits) == 1:
            gate.close_for(3.0)

    gate.wait_open(wait)
    gate.close_for(5.0)
    gate.close_for(1.0)
    gate.wait_open(wait)
    assert waits == [5.0, 3.0] and gate.closed_for() == 0


def test_estimates(spark):
    tags = [("ab", "cd"), ("\u00fc", None)]
    assert costs.vocabulary_size(tags) == (2 + 2 + 4 + 2 + 4, 2)
    c = spark.createDataFrame([(1, "gpt-4.1", 10.0, 7)], "clip_id long, model string, duration_s double, subtitle_bytes long")
    plain, cut = (costs.estimate_clips(c, s).first() for s in ("key_frames", "shots"))
    assert plain.input_tokens == 5 * 255 + 2 + 600 and cut.input_tokens == 60 * 255 + 602 and plain.output_tokens == 600
    assert abs(plain.usd - (plain.input_tokens * 2 + 600 * 8) / 1e6) < 1e-12
    more = costs.estimate_clips(c, "key_frames", tags).first()
    assert (more.input_tokens - plain.input_tokens, more.output_tokens - plain.output_tokens) == (4, 130)
    again = c.select("clip_id", "model", "subtitle_bytes", F.lit("12345678").alias("summary"), F.array(F.struct(F.lit("abc").alias("description"))).alias("segments"))
    assert costs.estimate_retagging(again, tags).first().input_tokens == int((7 + 8 + 23) / 3.5) + 600 + 4
    near = spark.createDataFrame([(2.0, 2.0, None, False), (2.0, 2.0, 2.0, True), (3.1, 2.0, 0.0, True), (3.0, 2.0, 0.0, False)], "g double, w double, b double, want boolean")
    assert near.where(sampling.needs_exact(F.col("g"), F.col("w"), F.col("b"), 2.0) != F.col("want")).count() == 0


def test_objects_and_messages(spark, tmp_path):
    shots = spark.createDataFrame([(1, 1, 5.0, 9.0, "fade"), (1, 0, 0.0, 4.0, None)], "clip_id long, pos int, start_s double, end_s double, enters_by string")
    files = spark.createDataFrame([(1, "a"), (2, "b")], "clip_id long, video string")
    got = {x.clip_id: json.loads(x.json) for x in outputs.shots_json(shots, files).collect()}
    assert got[2] == {"video": "b", "shots": [], "transitions": []}
    assert got[1]["shots"][0] == {"start_s": 0.0, "end_s": 4.0, "enters_by": None} and got[1]["transitions"] == [{"kind": "fade", "start_s": 4.0, "end_s": 5.0}]
    m = spark.createDataFrame([(3, "f", 1.5, "n", "d", "gpt-4.1", 10, 10)], "moment_id long, file string, at_s double, name string, description string, model string, input_tokens long, output_tokens long")
    one = json.loads(outputs.moment_json(m).first().json)
    assert list(one) == ["file", "at_s", "name", "description", "model", "usage", "cost_usd"] and abs(one["cost_usd"] - 1e-4) < 1e-12
    c = m.select(F.col("moment_id").alias("clip_id"), "file", F.lit(2.0).alias("duration_s"), F.lit(1).alias("frames"), F.lit("s").alias("summary"), F.expr("cast(null as struct<start_s:double,end_s:double>)").alias("main"), F.expr("array(named_struct('start_s', 0.0D, 'end_s', 1.0D, 'description', 'd'), named_struct('start_s', 1.0D, 'end_s', 2.0D, 'description', 'e'))").alias("segments"), F.expr("cast(null as array<string>)").alias("tags"), F.expr("cast(null as array<string>)").alias("new_tag_ideas"), "model", "input_tokens", "output_tokens", F.lit(None).cast("boolean").alias("cached"), F.lit(4).alias("group"), F.lit("g").alias("group_label"), F.expr("array(named_struct('start_s', 0.0D, 'end_s', 2.0D, 'group', 4, 'label', 'g'))").alias("stretches"), F.array(F.lit(4)).alias("segment_groups"))
    one = json.loads(outputs.clip_json(c, grouped=True).first().json)
    assert one["main"] is None and "tags" not in one and "cached" not in one and [x["group"] for x in one["moments"]] == [4, None] and one["stretches"][0]["label"] == "g"
    assert "group" not in json.loads(outputs.clip_json(c).first().json)
    said = spark.range(1).select(*[outputs.stop_message(F.lit(5.0), F.lit(1.25), n, F.lit(2), F.lit(3), F.lit(1), F.lit(saved)).alias(k) for k, n, saved in (("a", F.lit(6.0), True), ("b", F.lit(4.0), False), ("c", F.lit(None).cast("double"), True))]).first()
    assert said.a.startswith("Stopped at $5.00: 2 of 3 videos are left. $1.25 spent; the next one may take up to $6.00, which is more") and "1 described ones weren't saved" in said.b and "$1.25 spent. A higher" in said.c
    assert spark.range(1).select(outputs.problem_lines(F.array(F.lit("x")))).first()[0] == ["1 problem:", "  x"]
    both = outputs.in_order(outputs.all_outcomes(files.where("clip_id = 2"), files.where("clip_id = 1")), "folder", "clip_id").collect()
    assert [(x.folder, x.clip_id) for x in both] == [(0, 2), (1, 1)]
    frames = spark.createDataFrame([(1, 7.5, b"a"), (1, 7.5, b"bb"), (1, 12.0, b"c")], "clip_id long, time_s double, jpeg binary")
    for _ in range(2):
        assert [tuple(x) for x in outputs.dump_frames(frames, str(tmp_path), "interval").collect()] == [(1, 3)]
    index = json.loads((tmp_path / "1" / "frames.json").read_text())
    assert [(x["file"], x["bytes"]) for x in index] == [("0007.50s.jpg", 1), ("0007.50s-2.jpg", 2), ("0012.00s.jpg", 1)] and (tmp_path / "1" / "0007.50s-2.jpg").read_bytes() == b"bb"
