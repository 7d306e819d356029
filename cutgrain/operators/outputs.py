"""What a run writes: an object a clip, film or moment, and the lines that close a run. Names in objects are fixed values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutgrain.functions.costs import cost_usd, priced
from cutgrain.functions.text import dollars, format_time

_KEEP = {"ignoreNullFields": "false"}


def _usage() -> list[Column]:
    return [F.struct("input_tokens", "output_tokens").alias("usage"), cost_usd(F.col("input_tokens"), F.col("output_tokens")).alias("cost_usd")]


def clip_json(clips: DataFrame, grouped: bool = False) -> DataFrame:
    """(clip_id, file, duration_s, frames, summary, main, segments, tags, new_tag_ideas, model, input_tokens, output_tokens, cached) ->
    (clip_id, json).

    Null tags leave tags and ideas out, and clips that weren't cached have no `cached`; a clip without a main range has null.
    grouped takes (group, group_label, stretches, segment_groups) too and gives each moment its group, or null beyond the list.
    """
    p = priced(clips)
    use, usd = _usage()
    names = ("start_s", "end_s", "description")
    plain = F.transform("segments", lambda s: F.struct(*[s[n].alias(n) for n in names]))
    numbered = F.transform("segments", lambda s, i: F.struct(*[s[n].alias(n) for n in names], F.get("segment_groups", i).alias("group"))) if grouped else plain
    head = [F.col(c) for c in ("file", "duration_s", "frames", "summary", "main")] + [numbered.alias("moments")]
    tags = [F.col("tags"), F.col("new_tag_ideas")]
    groups = [F.col(c) for c in ("group", "group_label", "stretches")] if grouped else []
    tail = [F.col("model"), use, usd]
    said = lambda tagged, cached: F.to_json(F.struct(*head, *(tags if tagged else []), *groups, *tail, *([F.lit(True).alias("cached")] if cached else [])), _KEEP)
    none, hit = F.col("tags").isNull(), F.coalesce("cached", F.lit(False))
    body = F.when(none & ~hit, said(False, False)).when(none, said(False, True)).when(~hit, said(True, False)).otherwise(said(True, True))
    return p.select("clip_id", body.alias("json"))


def shots_json(shots: DataFrame, files: DataFrame) -> DataFrame:
    """(clip_id, pos, start_s, end_s, enters_by) and (clip_id, video) -> (clip_id, json): each film's shots, and the transitions between
    them from one's end to the next one's start. A film without shots has empty lists."""
    listed = shots.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start_s", "end_s", "enters_by"))).alias("l"))
    l = F.coalesce("l", F.expr("cast(array() as array<struct<pos:int,start_s:double,end_s:double,enters_by:string>>)"))  # noqa: E741
    got = files.join(listed, "clip_id", "left").withColumn("l", l)
    out = F.transform("l", lambda s: F.struct(s["start_s"].alias("start_s"), s["end_s"].alias("end_s"), s["enters_by"].alias("enters_by")))
    later = F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    between = F.transform(later, lambda s, i: F.struct(s["enters_by"].alias("kind"), F.get("l", i)["end_s"].alias("start_s"), s["start_s"].alias("end_s")))
    return got.select("clip_id", F.to_json(F.struct("video", out.alias("shots"), between.alias("transitions")), _KEEP).alias("json"))


def moment_json(moments: DataFrame) -> DataFrame:
    """(moment_id, file, at_s, name, description, model, input_tokens, output_tokens) -> (moment_id, json)."""
    use, usd = _usage()
    return priced(moments).select("moment_id", F.to_json(F.struct("file", "at_s", "name", "description", "model", use, usd), _KEEP).alias("json"))


def all_outcomes(*folders: DataFrame) -> DataFrame:
    """The outcomes of several folders as one, each row with its folder's number, so that rows can be put in order at the end."""
    return reduce(DataFrame.unionByName, [f.withColumn("folder", F.lit(i)) for i, f in enumerate(folders)])


def in_order(outcomes: DataFrame, *by: str) -> DataFrame:
    """Outcomes in the order in which their clips were given, however they came in."""
    return outcomes.orderBy(*by)


def summary_line(ended: Column, videos: Column) -> Column:
    """Of run_totals() columns with skipped and elapsed_s: the line that closes a run. `ended` is null for a run to its end, else
    cancelled or stopped."""
    n = F.col("described")
    head = F.when(ended.isNull(), F.format_string("done: %d %s", n, F.when(n == 1, "video").otherwise("videos"))).otherwise(F.format_string("%s: %d of %d videos finished", ended, n, videos))
    more = lambda c, word: F.when(F.col(c) > 0, F.format_string(" \u00b7 %d " + word, F.col(c))).otherwise("")
    return F.concat(head, F.format_string(" \u00b7 %d moments \u00b7 $%.2f \u00b7 %s", "moments", "cost_usd", format_time(F.col("elapsed_s"))), more("skipped", "skipped"), more("not_tried", "not tried"))


def problem_lines(problems: Column) -> Column:
    """array<string> -> the lines that list a run's problems again, none where there are none."""
    n = F.size(problems)
    head = F.format_string("%d %s:", n, F.when(n == 1, "problem").otherwise("problems"))
    return F.when(n > 0, F.concat(F.array(head), F.transform(problems, lambda p: F.concat(F.lit("  "), p)))).otherwise(F.expr("cast(array() as array<string>)"))


def stop_message(cap: Column, spent: Column, following: Column, left: Column, total: Column, described: Column, saved: Column) -> Column:
    """What to say of a run that its budget ended: `following` bounds the clip that didn't fit (null: not known)."""
    head = F.format_string("Stopped at %s: %d of %d videos are left. %s spent", dollars(cap), left, total, dollars(spent))
    why = F.when(following.isNull(), ".").when(following > cap, F.format_string("; the next one may take up to %s, which is more than the whole budget.", dollars(following))).otherwise(F.format_string("; the next one may take up to %s, which the rest of the budget doesn't cover.", dollars(following)))
    then = F.when(saved, " A higher budget goes on from here.").when(described > 0, F.format_string(" The %d described ones weren't saved and would be paid again; run with a cache.", described)).otherwise(" Raise the budget, and run with a cache.")
    return F.concat(head, why, then)


def frame_files(frames: DataFrame) -> DataFrame:
    """(clip_id, time_s, jpeg) -> (clip_id, file, time_s, bytes, jpeg): a name a frame by its time, numbered where a clip's frames share it."""
    own = F.format_string("%07.2fs", "time_s")
    w = Window.partitionBy("clip_id", "__n").orderBy("time_s", F.octet_length("jpeg"))
    got = frames.withColumn("__n", own).withColumn("__k", F.row_number().over(w))
    name = F.concat("__n", F.when(F.col("__k") > 1, F.concat(F.lit("-"), F.col("__k").cast("string"))).otherwise(""), F.lit(".jpg"))
    return got.select("clip_id", name.alias("file"), "time_s", F.octet_length("jpeg").alias("bytes"), "jpeg")


def dump_frames(frames: DataFrame, folder: str, picked: str) -> DataFrame:
    """Write each clip's frames and their index, frames.json, to folder/clip_id, which every executor must see -> (clip_id, frames); it
    happens when that is computed, and again it replaces what was there. For looking at what a sampling picks."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import os

        for b in batches:
            for clip, jpegs in zip(b["clip_id"], b["l"], strict=True):
                own = os.path.join(folder.removeprefix("file://"), str(clip))
                os.makedirs(own, exist_ok=True)
                for old in os.listdir(own):
                    if old.endswith((".jpg", ".json")):
                        os.remove(os.path.join(own, old))
                for f in jpegs:
                    with open(os.path.join(own, f["file"]), "wb") as out:
                        out.write(f["jpeg"])
                with open(os.path.join(own, "frames.json"), "w") as out:
                    json.dump([{"file": f["file"], "time_s": f["time_s"], "picked": picked, "bytes": f["bytes"]} for f in jpegs], out, indent=2)
            yield pd.DataFrame({"clip_id": b["clip_id"], "frames": [len(x) for x in b["l"]]})

    listed = frame_files(frames).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("time_s", "bytes", "file", "jpeg"))).alias("l"))
    return listed.mapInPandas(write, "clip_id long, frames long")
