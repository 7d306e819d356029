"""Requests to a provider: ordered content, the JSON schema of an answer, and when to try again."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.functions.costs import MODELS
from cutgrain.functions.text import collapse, format_time, trim
from cutgrain.operators.intervals import nearest_shot, overlap_join

#: Characters of notes that a request may carry.
LONGEST_NOTES = 2000


def _range(*more: tuple[str, dict]) -> dict:
    props = {"start_s": {"type": "number"}, "end_s": {"type": "number"}} | dict(more)
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


def _object(props: dict) -> dict:
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


_TEXT = {"type": "string"}


def _tag_props() -> dict:
    tag = {"name": _TEXT, "confidence": {"type": "number"}, "ranges": {"type": "array", "items": _range()}}
    return {"tags": {"type": "array", "items": _object(tag)}, "new_tag_ideas": {"type": "array", "items": _TEXT}}


def answer_schema(important: bool = True, tags: bool = False) -> str:
    """JSON schema of a description, with tags where they are asked for; which names are known is for parse_tags() to say."""
    props: dict = {"summary": _TEXT, "segments": {"type": "array", "items": _range(("description", _TEXT))}}
    if important:
        props |= {"main": {"type": "array", "items": _range()}, "distinct_parts": {"type": "boolean"}}
    return json.dumps(_object(props | _tag_props() if tags else props))


def tags_schema() -> str:
    """JSON schema of an answer that only has tags."""
    return json.dumps(_object(_tag_props()))


def moment_schema() -> str:
    """JSON schema of a moment's name and description."""
    return json.dumps(_object({"name": _TEXT, "description": _TEXT}))


def check_notes(notes: Column) -> Column:
    """Null where notes may be sent, else why not."""
    n = F.char_length(trim(F.coalesce(notes, F.lit(""))))
    return F.when(n > LONGEST_NOTES, F.format_string("Notes are %d characters long; at most %d are allowed", n, F.lit(LONGEST_NOTES)))


def tag_instructions(tags: list[tuple[str, str | None]]) -> str:
    """What a request for tags says of a vocabulary of (name, hint)."""
    listed = "".join(f"{name} \u2014 {hint}\n" if hint else f"{name}\n" for name, hint in tags)
    return (
        "\nName each tag of the list below that fits, spelled as it is there, with a confidence between 0 and 1. Give time ranges only "
        f"where a tag fits a part of the clip.\n\nTags:\n{listed}\nA fitting tag that the list lacks goes to new_tag_ideas and never to tags.\n"
    )


def with_notes(instructions: Column, notes: Column, tags: bool = False) -> Column:
    """Instructions followed by the user's notes, where they say something, fenced off: no note can end its own section."""
    said = trim(F.coalesce(notes, F.lit("")))
    fenced = F.replace(said, F.lit("</notes>"), F.lit("<\u200b/notes>"))
    more = " Tags that the notes name and the list lacks go to new_tag_ideas." if tags else ""
    rule = f"\n</notes>\nThe notes guide what is named and marked; the form and the language of the answer stay as they are.{more}"
    return F.when(said == "", instructions).otherwise(F.concat(instructions, F.lit("\n\nNotes of the user:\n<notes>\n"), fenced, F.lit(rule)))


def _spoken(cues: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, start_ms, end_ms, text) -> (key, said): a line a cue, by start and then text."""
    line = F.concat(format_time(F.col("start_ms") / 1000), F.lit("-"), format_time(F.col("end_ms") / 1000), F.lit(" "), collapse(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("start_ms", line.alias("l"))))
    return cues.groupBy(key).agg(F.concat(F.lit("Subtitles:\n"), F.array_join(F.transform(listed, lambda s: s["l"]), "\n")).alias("said"))


def _item(at: int, sub: Column, kind: str, text: Column, jpeg: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), sub.cast("double").alias("sub"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), jpeg.cast("binary").alias("jpeg"))


def _frame_items(label: Column) -> Column:
    """Of (time_s, jpeg): the label, and the picture behind it."""
    return F.explode(F.array(_item(1, F.col("time_s") * 2, "text", label, F.lit(None)), _item(1, F.col("time_s") * 2 + 1e-9, "jpeg", F.lit(None), F.col("jpeg")))).alias("i")


def _contents(items: DataFrame, key: str) -> DataFrame:
    inner = F.transform(F.array_sort(F.collect_list("i")), lambda i: F.struct(i["kind"].alias("kind"), i["text"].alias("text"), i["jpeg"].alias("jpeg")))
    return items.groupBy(key).agg(inner.alias("content"))


_SHOTS = "\n\nThe clip is cut from %d shots. Each frame names its shot with the seconds at which that starts and ends; take these where a segment starts or ends at a cut."


def build_requests(clips: DataFrame, frames: DataFrame, cues: DataFrame, instructions: str, shots: DataFrame | None = None, tags: list[tuple[str, str | None]] | None = None) -> DataFrame:
    """(clip_id, duration_s, notes), (clip_id, time_s, jpeg), (clip_id, start_ms, end_ms, text) -> (clip_id, content).

    content is array<struct<kind, text, jpeg>> in the order in which it is sent: instructions with the vocabulary, if one is
    given, and the clip's notes, each frame after its time, then the subtitles. With shots (clip_id, pos, start_s, end_s), the
    frames of clips of two and more say which they are in.
    """
    nothing = F.lit(None)
    f, c = frames, clips.select("clip_id", "duration_s", "notes")
    label = F.concat(F.lit("Frame at "), format_time(F.col("time_s")))
    head = F.concat(F.lit(instructions), F.format_string("\nThe clip is %.1f s long.", "duration_s"), F.lit(tag_instructions(tags) if tags is not None else ""))
    if shots is not None:
        counts = shots.groupBy("clip_id").agg(F.count("*").alias("shots"))
        spans = shots.select("clip_id", "pos", "start_s", "end_s").join(counts.where("shots > 1"), "clip_id")
        f = nearest_shot(frames, shots).join(spans, ["clip_id", "pos"], "left")
        where = F.format_string(" (shot %d of %d, %.1f-%.1f s)", F.col("pos") + 1, "shots", "start_s", "end_s")
        label = F.concat(label, F.when(F.col("shots").isNotNull(), where).otherwise(""))
        c = c.join(counts, "clip_id", "left")
        head = F.concat(head, F.when(F.col("shots") > 1, F.format_string(_SHOTS, "shots")).otherwise(""))
    head = with_notes(head, F.col("notes"), tags is not None)
    rows = c.select("clip_id", _item(0, F.lit(0), "text", head, nothing).alias("i")).union(f.select("clip_id", _frame_items(label)))
    rows = rows.union(_spoken(cues).select("clip_id", _item(2, F.lit(0), "text", F.col("said"), nothing).alias("i")))
    return _contents(rows.join(clips.select("clip_id"), "clip_id", "left_semi"), "clip_id")


def build_tags_requests(described: DataFrame, cues: DataFrame, tags: list[tuple[str, str | None]]) -> DataFrame:
    """(clip_id, duration_s, notes, summary, segments) and (clip_id, start_ms, end_ms, text) -> (clip_id, content): one text that asks for
    tags of a clip by its description and subtitles, without frames."""
    line = lambda s: F.concat(F.lit("\n"), format_time(s["start_s"]), F.lit("-"), format_time(s["end_s"]), F.lit(" "), s["description"])
    listed = F.when(F.size("segments") > 0, F.concat(F.lit("\nSegments:"), F.array_join(F.transform("segments", line), ""))).otherwise("")
    d = described.join(_spoken(cues), "clip_id", "left")
    head = F.concat(F.lit("A clip "), format_time(F.col("duration_s")), F.lit(" long is described as follows.\nSummary: "), F.col("summary"), listed, F.coalesce(F.concat(F.lit("\n"), F.col("said")), F.lit("")), F.lit("\n" + tag_instructions(tags)))
    return _contents(d.select("clip_id", _item(0, F.lit(0), "text", with_notes(head, F.col("notes"), True), F.lit(None)).alias("i")), "clip_id")


def build_moment_requests(moments: DataFrame, frames: DataFrame, cues: DataFrame) -> DataFrame:
    """(moment_id, clip_id, at_s, window_s, notes), (moment_id, time_s, jpeg) and (clip_id, start_ms, end_ms, text) -> (moment_id, content):
    the moment's time, the notes and the cues that touch its window, then each frame after its time."""
    w = F.greatest(F.col("window_s"), F.lit(0.0))
    windows = moments.select("moment_id", "clip_id", (F.col("at_s") - w).alias("lo"), (F.col("at_s") + w).alias("hi"))
    timed = cues.select("clip_id", "start_ms", "end_ms", "text", (F.col("start_ms") / 1000).alias("cue_lo"), (F.col("end_ms") / 1000).alias("cue_hi"))
    near = overlap_join(windows, timed, ["clip_id"], ("lo", "hi"), ("cue_lo", "cue_hi"))
    m = moments.join(_spoken(near, "moment_id"), "moment_id", "left")
    ask = "Name what happens at %s of a clip in a few words, and describe it in one or two sentences. Say only what is seen and said, and don't guess who someone is."
    head = F.concat(F.format_string(ask, format_time(F.col("at_s"))), F.coalesce(F.concat(F.lit("\n\n"), F.col("said")), F.lit("")))
    rows = m.select("moment_id", _item(0, F.lit(0), "text", with_notes(head, F.col("notes")), F.lit(None)).alias("i"))
    label = F.concat(F.lit("Frame at "), format_time(F.col("time_s")))
    rows = rows.union(frames.select("moment_id", _frame_items(label)))
    return _contents(rows.join(moments.select("moment_id"), "moment_id", "left_semi"), "moment_id")


def resolve_model(provider: str | None, model: str | None) -> str:
    """The model that a provider and a model id name together; a provider alone means its first, neither the first of all."""
    by_id = {m[0]: m[1] for m in MODELS}
    if model is not None:
        if model not in by_id:
            raise ValueError(f"unknown model {model!r}")
        if provider not in (None, by_id[model]):
            raise ValueError(f"{model} isn't a model of {provider}")
        return model
    names = [m[0] for m in MODELS if provider in (None, m[1])]
    if not names:
        raise ValueError(f"unknown provider {provider!r}")
    return names[0]


@dataclass(frozen=True)
class Retries:
    """Waits before further attempts, and how many limit replies in a row are waited out."""

    delays_s: tuple[float, ...] = (2.0, 8.0, 30.0)
    limit_waits: int = 20
    limit_delay_s: float = 30.0

    def run(self, attempt: Callable[[], tuple[str, float | None]], wait: Callable[[float], None]) -> str:
        """attempt() -> (kind, seconds that the reply asks to wait); `retry` uses up a delay and clears the count of `limit`
        replies, which use up none. The last kind is returned."""
        used = limits = 0
        while True:
            kind, asked = attempt()
            if kind == "limit" and limits < self.limit_waits:
                limits += 1
                wait(asked if asked is not None else self.limit_delay_s)
            elif kind in ("retry", "overloaded") and used < len(self.delays_s):
                limits = 0
                wait(self.delays_s[used])
                used += 1
            else:
                return kind


class Gate:
    """A pause that the requests of one process share: while it is closed none is sent. A shorter pause never ends a longer one."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self._clock, self._opens, self._lock = clock, float("-inf"), threading.Lock()

    def close_for(self, seconds: float) -> None:
        with self._lock:
            self._opens = max(self._opens, self._clock() + seconds)

    def closed_for(self) -> float:
        with self._lock:
            return max(0.0, self._opens - self._clock())

    def wait_open(self, wait: Callable[[float], None] = time.sleep) -> None:
        """Return once it is open, however often it is closed again meanwhile."""
        while (left := self.closed_for()) > 0:
            wait(left)


def display_names(paths: DataFrame) -> DataFrame:
    """(path) -> with `name`: the file's own name, or the whole path where several files share it."""
    own = F.regexp_extract("path", r"([^/\\]+)$", 1)
    shared = paths.select(own.alias("own")).groupBy("own").agg(F.count("*").alias("files"))
    return paths.withColumn("own", own).join(shared, "own").select("path", F.when(F.col("files") > 1, F.col("path")).otherwise(F.col("own")).alias("name"))


def plan_totals(clips: DataFrame, longest_s: float = 1800.0) -> DataFrame:
    """(duration_s, input_tokens, output_tokens, usd) of estimated clips, null durations unreadable -> one row of totals; what can't be
    read or is too long costs nothing."""
    fits = F.col("duration_s") <= longest_s
    total = lambda c, zero: F.coalesce(F.sum(F.when(fits, F.col(c))), F.lit(zero)).alias(c)
    return clips.agg(
        F.count_if(fits).alias("clips"),
        *[total(c, z) for c, z in (("duration_s", 0.0), ("input_tokens", 0), ("output_tokens", 0), ("usd", 0.0))],
        F.count_if(F.col("duration_s") > longest_s).alias("too_long"),
        F.count_if(F.col("duration_s").isNull()).alias("unreadable"),
    )
