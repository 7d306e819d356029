"""The cache: strict records, the last one of a file, what is written is read, and streams into it."""

import base64
import json

from pyspark.sql import functions as F

from cutgrain.sources import cache
from cutgrain.streaming.resume import describe_stream

BASE = {
    "v": 1, "size": 5, "modified_ns": 2**63 + 7, "sample_hash": "00ff", "settings": "s", "file": "/a", "model": "m", "duration_s": 4,
    "usage": {"input_tokens": 1, "output_tokens": 2}, "summary": "x", "main": {"start_s": 1, "end_s": 2.5}, "segments": [{"start_s": 0, "end_s": 1, "description": "d"}],
    "tags": {"tags": [{"name": "n", "confidence": 1, "ranges": [{"start_s": 0, "end_s": 1}]}], "new_tag_ideas": ["i"]}, "frames": [{"t": 0.5, "fp": base64.b64encode(b"abcd").decode()}],
}


def but(**change):
    return json.dumps(BASE | change)


def lines_of(spark, raw):
    return spark.createDataFrame(list(enumerate(raw)), "line_no long, raw string")


def test_a_bad_field_drops_the_record(spark):
    bad = [
        but(size=-1), but(size="5"), but(size=1.5), but(modified_ns=2**64), but(sample_hash="xyz"), but(sample_hash="1" * 17), but(sample_hash=""), but(settings=None), but(file=3), but(model=[]),
        but(duration_s="4"), but(usage={"input_tokens": 1}), but(summary=None), but(segments=None), but(segments={}), but(segments=[{"start_s": 0, "end_s": 1}]), but(segments=[None]),
        but(tags=[]), but(tags={"tags": []}), but(tags={"tags": [], "new_tag_ideas": [1]}), but(tags={"tags": [{"name": "n", "confidence": 1}], "new_tag_ideas": []}),
        but(tags={"tags": [{"name": "n", "confidence": 1, "ranges": [{"start_s": 1}]}], "new_tag_ideas": []}), but(frames=[{"t": 1, "fp": "a==="}]), but(frames=[{"t": 1, "fp": "YWJjZA"}]), but(frames=[{"fp": ""}]), but(v="1"), but(v=0), "garbage", "", "[]", None,
    ]
    assert cache.read_cache(lines_of(spark, bad)).count() == 0
    fine = [but(size=i, **c) for i, c in enumerate([{}, {"main": None}, {"main": {"start_s": "1", "end_s": 2}}, {"tags": None}, {"segments": []}, {"frames": []}, {"frames": [{"t": 1, "fp": ""}]}, {"tags": {"tags": [], "new_tag_ideas": []}}, {"more": 1}])]
    got = {int(r["size"]): r for r in cache.read_cache(lines_of(spark, fine)).collect()}
    assert sorted(got) == list(range(9)) and [got[i].clip.main is None for i in range(4)] == [False, True, True, False]
    assert got[3].clip.tags is None and got[7].clip.tags.tags == [] and bytes(got[0].clip.frames[0].fp) == b"abcd" and got[0].sample_hash == "00000000000000ff"


def test_last_good_line_counts(spark):
    raw = [but(settings="1"), but(settings="2"), but(settings="3", summary=None), "garbage", but(v=2), but(size=6), but(v=2)]
    lines = lines_of(spark, raw)
    assert {(int(r["size"]), r.settings) for r in cache.read_cache(lines).collect()} == {(5, "2"), (6, "s")}
    assert sorted(r.line_no for r in cache.compact(lines).collect()) == [1, 4, 5, 6]
    clips = spark.createDataFrame([(1, "1"), (2, "2")], "clip_id int, settings string").withColumn("identity", F.lit(f"5-{2**63 + 7}-00000000000000ff"))
    assert {r.clip_id: r.cached for r in cache.cached_answers(clips, cache.read_cache(lines)).collect()} == {1: False, 2: True}
    assert cache.read_cache(lines.limit(0)).count() == 0


def test_written_lines_are_read(spark, tmp_path):
    got = cache.read_cache(lines_of(spark, [but(), but(size=6, main=None, tags=None)])).drop("line_no")
    cache.append(got, f"file://{tmp_path}/c", "a")
    cache.append(got.where("size = 6").withColumn("settings", F.lit("later")), f"file://{tmp_path}/c", "b")
    back = {int(r["size"]): r for r in cache.read_cache(cache.read_lines(spark, f"file://{tmp_path}/c")).drop("line_no").collect()}
    assert back[5] == got.where("size = 5").first() and back[6].settings == "later" and back[6].clip.tags is None
    (tmp_path / "one.jsonl").write_text("\n".join([but(settings="1"), but(settings="2")]) + "\n" + but()[:40])
    assert [r.settings for r in cache.read_cache(cache.read_lines(spark, f"file://{tmp_path}/one.jsonl")).collect()] == ["2"]


def test_stream_appends(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    record = cache.read_cache(lines_of(spark, [but()])).first()

    def describe(batch):
        clip = F.from_json(F.lit(json.dumps({"duration_s": 1, "summary": "s", "usage": {"input_tokens": 1, "output_tokens": 1}, "segments": [], "frames": []})), cache.CLIP)
        return batch.select(F.col("clip_id").alias("size"), F.lit(1).alias("modified_ns"), F.lit(record.sample_hash).alias("sample_hash"), F.lit("s").alias("settings"), F.lit("f").alias("file"), F.lit("m").alias("model"), clip.alias("clip"))

    for n in range(2):
        spark.createDataFrame([(n, 30.0), (n, 30.0)], "clip_id long, duration_s double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("clip_id long, duration_s double").parquet(source)
        describe_stream(stream, describe, out, mark).awaitTermination()
    assert sorted(int(r["size"]) for r in cache.read_cache(cache.read_lines(spark, out)).collect()) == [0, 1]
    assert cache.read_lines(spark, out).count() == 2


def test_folders_are_compacted_by_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert cache.read_folder(spark, path).count() == 0 and cache.compact_folder(spark, path) == 0
    whole = lambda lines: sorted((r.identity, r.settings, r.file) for r in cache.read_cache(lines).collect())

    def part(name, *rows):
        body = [but(size=n, settings=s) for n, s in rows] + ["not json", but(v=7, size=99)]
        spark.createDataFrame([(x,) for x in body], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part={name}")

    part("a", (1, "x"), (2, "x"), (3, "x"))
    part("b", (2, "y"))
    want = whole(cache.read_lines(spark, path))
    assert whole(cache.read_folder(spark, path)) == want and len(want) == 3
    assert cache.compact_folder(spark, path, 8) == 1 == cache.compact_folder(spark, path, 8)
    assert whole(cache.read_folder(spark, path)) == want
    first = {p.name for p in (tmp_path / "cache/_base/gen=1").iterdir() if p.name.startswith("bucket")}
    part("a", (1, "garbage that nobody reads"))  # merged parts aren't looked at again
    part("c", (3, "z"), (4, "z"))
    got = whole(cache.read_folder(spark, path))
    assert {(s) for _, s, _ in got} == {"x", "y", "z"} and len(got) == 4
    assert cache.compact_folder(spark, path) == 2 and whole(cache.read_folder(spark, path)) == got
    second = {p.name for p in (tmp_path / "cache/_base/gen=2").iterdir() if p.name.startswith("bucket")}
    assert second and len(second) <= 3 and len(first | second) > len(second)
    one = next(i for i, s, _ in got if s == "y")
    assert (one, "y") in {(i, s) for i, s, _ in whole(cache.read_folder(spark, path, [one]))}
    assert sum('"v": 7' in r.raw or '"v":7' in r.raw for r in cache.read_folder(spark, path).collect()) == 3
    # a generation without its state was never made
    (tmp_path / "cache/_base/gen=3/bucket=0").mkdir(parents=True)
    (tmp_path / "cache/_base/gen=3/bucket=0/part-x.txt").write_text(but(size=1, settings="lost") + "\n")
    assert whole(cache.read_folder(spark, path)) == got


def test_settings_key(spark):
    row = spark.createDataFrame([("m", "en", "none", " be brief ")], "m string, l string, s string, n string")
    key = lambda notes: row.select(cache.settings_key(F.col("m"), F.col("l"), "key_frames", True, cache.vocabulary_key(None), F.col("s"), notes)).first()[0]
    plain = "model=m language=en frames=keyframes moments=important tags=none subtitles=none"
    h = 14695981039346656037
    for b in b"be brief":
        h = (h ^ b) * 1099511628211 % 2**64
    assert key(F.lit(" ")) == plain and key(F.col("n")) == f"{plain} instructions={h:016x}"
    assert len({cache.vocabulary_key(v) for v in ([], [("a", None)], [("a", "b")], [("ab", None)], [("a", ""), ("b", None)])}) == 5
