"""Recorded model answers, parsed and strictly validated: JSON as VARIANT, with a guard on each value's type.

from_json would null a whole array for one bad element and coerce numbers to text; extraction from a variant alone
would coerce text to numbers. A value counts only if the JSON has it in its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.functions.costs import max_segments
from cutgrain.functions.text import repeats_summary, trim
from cutgrain.functions.variants import boolean, items, number, once, string

#: A segment of this share of the clip, or ranges that cover it, say nothing about parts.
WHOLE_CLIP = 0.9

#: Messages of failed answers (fixed values: they are what a run's list of failures shows).
TOO_LONG, STOPPED = "The answer was too long", "The model stopped early ("
DECLINED, DECLINED_TAGS = "The model declined to describe it", "The model declined to suggest tags"
NO_SUMMARY, NO_MOMENT = "The answer had no summary", "The answer had no name or no description"


def stop_error(stop_reason: Column, declined: str = DECLINED) -> Column:
    """Why an answer can't be used, or null."""
    early = F.concat(F.lit(STOPPED), F.coalesce(stop_reason, F.lit("")), F.lit(")"))
    return F.when(stop_reason == "end_turn", F.lit(None).cast("string")).when(stop_reason == "max_tokens", TOO_LONG).when(stop_reason == "refusal", declined).otherwise(early)


_SEGMENTS = "array<struct<start_s:double,end_s:double,description:string>>"
_ANSWER = ("error", "summary", "segments", "main")
_TAG = "name:string,confidence:double,ranges:array<struct<start_s:double,end_s:double>>"
#: Names that a vocabulary has at most.
MOST_TAGS = 100_000


def _merged(segments: Column) -> Column:
    """merge_neighbours() of an array that is sorted."""
    same = lambda acc, x: F.lower(trim(F.element_at(acc, -1)["description"])) == F.lower(trim(x["description"]))
    last = lambda acc, x: F.struct(F.element_at(acc, -1)["start_s"].alias("start_s"), F.greatest(F.element_at(acc, -1)["end_s"], x["end_s"]).alias("end_s"), F.element_at(acc, -1)["description"].alias("description"))
    step = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(same(acc, x), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last(acc, x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(segments, F.expr(f"cast(array() as {_SEGMENTS})"), step)


def _covered(segments: Column, lo: Column, hi: Column) -> Column:
    """Seconds of [lo, hi] that an array of spans sorted by start covers, overlaps counted once."""
    start = F.struct(lo.cast("double").alias("reached"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        a, b = F.greatest(x["start_s"], acc["reached"]), F.least(x["end_s"], hi)
        return F.struct(F.greatest(acc["reached"], b).alias("reached"), (acc["sum"] + F.greatest(F.lit(0.0), b - a)).alias("sum"))

    return F.aggregate(segments, start, step, lambda acc: acc["sum"])


def parse_answers(answers: DataFrame, important: bool = True) -> DataFrame:
    """(clip_id, duration_s, body, stop_reason) -> (clip_id, error, summary, segments array<struct<start_s, end_s, description>>, main).

    In order: stop reason, summary, each segment's validity, sorting by start; then, for important moments only, neighbours
    of one description merged, whole-clip segments and repeats of the summary dropped, the main range, and ranges that
    tile the clip cleared; then at most so many segments as the duration allows. An answer is read within its row: nothing is
    shuffled, and its segments are as many as a model's answer can hold.
    """
    got = _answer(important)
    # generated, so that no filter above reads an answer again
    return answers.select("clip_id", F.explode_outer(F.array(got)).alias("p")).select("clip_id", *[F.col("p")[c].alias(c) for c in _ANSWER])


def _answer(important: bool) -> Column:
    """A row's answer as a struct of _ANSWER, of the columns duration_s, body and stop_reason."""
    duration = F.col("duration_s")
    full = WHOLE_CLIP * duration
    none = F.expr(f"cast(array() as {_SEGMENTS})")
    no_main = F.expr("cast(null as struct<start_s:double,end_s:double>)")

    def read(j: Column) -> Column:
        summary = F.coalesce(trim(string(j, "$.summary")), F.lit(""))
        error = F.coalesce(stop_error(F.col("stop_reason")), F.when(summary == "", NO_SUMMARY))
        row = lambda v, i: F.struct(number(v, "$.start_s").alias("start_s"), i.alias("item"), number(v, "$.end_s").alias("end_s"), trim(string(v, "$.description")).alias("description"))
        ended = F.filter(F.transform(items(j, "$.segments"), row), lambda s: s["end_s"].isNotNull())
        cut = F.transform(ended, lambda s: s.withField("end_s", F.least(s["end_s"], duration)))
        valid = F.filter(cut, lambda s: F.coalesce((s["start_s"] >= 0) & (s["end_s"] > s["start_s"]) & (s["start_s"] < duration + 1) & (s["description"] != ""), F.lit(False)))
        segments = F.coalesce(F.transform(F.array_sort(valid), lambda s: s.dropFields("item")), none)
        first = F.try_element_at(items(j, "$.main"), F.lit(1))
        lo, hi = number(first, "$.start_s"), number(first, "$.end_s")
        said = F.when(lo.isNotNull() & hi.isNotNull(), F.struct(F.greatest(lo, F.lit(0.0)).alias("start_s"), F.least(hi, duration).alias("end_s")))
        return F.struct(error.alias("error"), summary.alias("summary"), segments.alias("segments"), said.alias("main"), F.coalesce(boolean(j, "$.distinct_parts"), F.lit(False)).alias("distinct"))

    def parted(r: Column) -> Column:
        m = r["main"]
        main = F.when((m["end_s"] > m["start_s"]) & (m["start_s"] < duration) & (m["end_s"] - m["start_s"] < full), m)
        own = F.filter(_merged(r["segments"]), lambda s: (s["end_s"] - s["start_s"] < full) & ~repeats_summary(s["description"], r["summary"]))
        return r.withField("main", main).withField("segments", own)

    def measured(r: Column) -> Column:
        in_main = F.when(r["main"].isNull(), 0.0).otherwise(_covered(r["segments"], r["main"]["start_s"], r["main"]["end_s"]))
        return r.withField("all_s", _covered(r["segments"], F.lit(0.0), duration)).withField("in_main", in_main)

    def cleared(r: Column) -> Column:
        main_s = r["main"]["end_s"] - r["main"]["start_s"]
        tiles = F.when(r["main"].isNull(), r["all_s"] >= full).otherwise((r["all_s"] + main_s - r["in_main"] >= full) | (r["in_main"] >= WHOLE_CLIP * main_s))
        return r.withField("segments", F.when(~(r["main"].isNull() & r["distinct"]) & tiles, none).otherwise(r["segments"]))

    def told(r: Column) -> Column:
        ok = r["error"].isNull()
        most = F.slice(r["segments"], F.lit(1), max_segments(duration))
        main = F.when(ok, r["main"]) if important else no_main
        return F.struct(r["error"].alias("error"), F.when(ok, r["summary"]).alias("summary"), F.when(ok, most).alias("segments"), main.alias("main"))

    got = F.try_parse_json("body")
    for step in (read, *((parted, measured, cleared) if important else ()), told):
        got = once(got, step)
    return got


def known_names(vocabulary: DataFrame) -> list[str]:
    """A vocabulary's names. It goes whole into each request, so it is small; more than MOST_TAGS names are an error."""
    names = [r[0] for r in vocabulary.where("name is not null").select("name").distinct().limit(MOST_TAGS + 1).collect()]
    if len(names) > MOST_TAGS:
        raise ValueError(f"a vocabulary has at most {MOST_TAGS} names")
    return sorted(names)


def _tags(names: list[str]) -> Column:
    """A row's suggested tags as an array of (pos, name, confidence, ranges), of the columns duration_s and body."""
    duration = F.col("duration_s")
    none = F.expr(f"cast(array() as array<struct<pos:int,{_TAG}>>)")
    known = (lambda name: name.isin(names)) if names else (lambda name: F.lit(False))

    def ranges_of(raw: Column) -> Column:
        read = F.transform(raw, lambda x, i: F.struct(number(x, "$.start_s").alias("start_s"), i.alias("item"), F.when(number(x, "$.end_s").isNotNull(), F.least(number(x, "$.end_s"), duration)).alias("end_s")))
        good = F.filter(read, lambda x: F.coalesce((x["start_s"] >= 0) & (x["end_s"] > x["start_s"]) & (x["start_s"] < duration + 1), F.lit(False)))
        return F.transform(F.array_sort(good), lambda x: x.dropFields("item"))

    def entry(x: Column) -> Column:
        raw = F.coalesce(items(x["v"], "$.ranges"), F.expr("cast(array() as array<variant>)"))
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(x["v"], "$.confidence")))
        # greatest() and least() pass over nulls
        confidence = F.when(number(x["v"], "$.confidence").isNotNull(), confidence)
        return F.struct(x["pos"].alias("pos"), x["name"].alias("name"), confidence.alias("confidence"), ranges_of(raw).alias("ranges"), F.size(raw).alias("n"))

    def read(found: Column) -> Column:
        named = F.filter(F.transform(found, lambda v, i: F.struct(i.alias("pos"), trim(string(v, "$.name")).alias("name"), v.alias("v"))), lambda x: F.coalesce(known(x["name"]), F.lit(False)))
        return once(named, lambda ns: F.filter(F.transform(ns, lambda x, i: F.struct(x["pos"].alias("pos"), x["name"].alias("name"), x["v"].alias("v"), (F.array_position(F.transform(ns, lambda y: y["name"]), x["name"]) == i + 1).alias("first"))), lambda x: x["first"]))

    got = once(items(F.try_parse_json("body"), "$.tags"), read)
    kept = F.filter(F.transform(got, entry), lambda t: t["confidence"].isNotNull() & ((t["n"] == 0) | (F.size(t["ranges"]) > 0)))
    return F.coalesce(F.transform(kept, lambda t: t.dropFields("n")), none)


def _ideas() -> Column:
    found = F.transform(items(F.try_parse_json("body"), "$.new_tag_ideas"), lambda x: trim(string(x, "$")))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.expr("cast(array() as array<string>)"))


def parse_tags(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(clip_id, duration_s, body) and (name) -> (clip_id, pos, name, confidence, ranges array<struct<start_s, end_s>>).

    Unknown names are dropped. Of a name's entries only the first counts, and it counts as seen before its confidence and
    ranges are looked at. An empty list of ranges is the whole clip; a list whose ranges are all invalid drops the tag. Ranges
    come by start, those of one start as the answer has them. An answer is read within its row, so two of one clip stay two.
    """
    return answers.select("clip_id", F.explode(_tags(known_names(vocabulary))).alias("t")).select("clip_id", "t.*")


def parse_new_tag_ideas(answers: DataFrame) -> DataFrame:
    """(clip_id, body) -> (clip_id, ideas array<string>): texts only, trimmed, blank ones dropped, repeats kept."""
    return answers.select("clip_id", _ideas().alias("ideas"))


def parse_moments(answers: DataFrame) -> DataFrame:
    """(clip_id, body, stop_reason) -> (clip_id, error, name, description)."""
    j = F.try_parse_json("body")
    a = answers.select("clip_id", stop_error(F.col("stop_reason")).alias("e"), F.coalesce(trim(string(j, "$.name")), F.lit("")).alias("name"), F.coalesce(trim(string(j, "$.description")), F.lit("")).alias("description"))
    error = F.coalesce("e", F.when((F.col("name") == "") | (F.col("description") == ""), NO_MOMENT))
    return a.select("clip_id", error.alias("error"), F.when(error.isNull(), F.col("name")).alias("name"), F.when(error.isNull(), F.col("description")).alias("description"))


def _lists(vocabulary: DataFrame) -> list[Column]:
    return [F.transform(_tags(known_names(vocabulary)), lambda t: t.dropFields("pos")).alias("tags"), _ideas().alias("ideas")]


def parse_combined(answers: DataFrame, vocabulary: DataFrame, important: bool = True) -> DataFrame:
    """(clip_id, duration_s, body, stop_reason) -> parse_answers() with tags and ideas, which are null where there is an error."""
    got = answers.select("clip_id", F.explode_outer(F.array(F.struct(_answer(important).alias("a"), *_lists(vocabulary)))).alias("p"))
    return got.select("clip_id", *[F.col("p.a")[c].alias(c) for c in _ANSWER], *[F.when(F.col("p.a.error").isNull(), F.col("p")[c]).alias(c) for c in ("tags", "ideas")])


def parse_tags_only(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(clip_id, duration_s, body, stop_reason) -> (clip_id, error, tags, ideas); there is no description to look at."""
    got = answers.select("clip_id", stop_error(F.col("stop_reason"), DECLINED_TAGS).alias("error"), F.explode_outer(F.array(F.struct(*_lists(vocabulary)))).alias("p"))
    return got.select("clip_id", "error", *[F.when(F.col("error").isNull(), F.col("p")[c]).alias(c) for c in ("tags", "ideas")])
