"""SRT and ASS subtitles: tables of (clip_id, text) become cues (clip_id, start_ms, end_ms, text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cutgrain.functions.text import trim


def _unix(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n", "\n")


_SRT = r"^\s*\+?(\d+)\s*:\s*\+?(\d+)\s*:\s*\+?(\d+)\s*(?:[,.]\s*\+?(\d+)\s*)?$"


def srt_ms(stamp: Column) -> Column:
    """HH:MM:SS[,.]mmm -> ms; the fraction is taken as whole ms and may lack; null where it isn't a time, or is absurd."""
    part = lambda i: F.regexp_extract(stamp, _SRT, i).try_cast("bigint")
    total = F.try_add(F.try_multiply(F.try_add(F.try_multiply(F.try_add(F.try_multiply(part(1), F.lit(60)), part(2)), F.lit(60)), part(3)), F.lit(1000)), F.coalesce(part(4), F.lit(0).cast("bigint")))
    return F.when(stamp.rlike(_SRT), total)


def parse_srt(files: DataFrame) -> DataFrame:
    """(clip_id, text) -> cues by start. Malformed blocks, empty texts and ends not after starts are skipped."""
    blocks = files.select("clip_id", F.posexplode(F.split(_unix(F.col("text")), "\n\n")).alias("pos", "block"))
    lines = F.split(F.regexp_replace("block", r"^\n+", ""), "\n")
    timed = F.when(F.contains(lines[0], F.lit("-->")), F.lit(1)).when(F.contains(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), F.lit("-->")), F.lit(2))
    b = blocks.select("clip_id", "pos", lines.alias("lines"), timed.alias("at")).where("at is not null")
    arrow = F.split(F.element_at("lines", F.col("at")), "-->")
    b = b.select("clip_id", "pos", srt_ms(arrow[0]).alias("start_ms"), srt_ms(F.split(trim(F.try_element_at(arrow, F.lit(2))), r"\s")[0]).alias("end_ms"), trim(F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))), "\n")).alias("text"))
    good = b.where("start_ms is not null and end_ms > start_ms and text != ''")
    return good.select("clip_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms", "pos")) - 1).alias("pos"), "start_ms", "end_ms", "text")


def ass_ms(stamp: Column) -> Column:
    """H:MM:SS.f+ -> ms; the fraction is cut to three digits and scaled; null where it isn't a time or is absurd."""
    m = r"^(\d+):(\d+):(\d+)(?:\.(\d+))?$"
    s = trim(stamp)
    part = lambda i: F.regexp_extract(s, m, i).try_cast("bigint")
    frac = F.rpad(F.substring(F.regexp_extract(s, m, 4), 1, 3), 3, "0").try_cast("bigint")
    total = F.try_add(F.try_multiply(F.try_add(F.try_multiply(F.try_add(F.try_multiply(part(1), F.lit(60)), part(2)), F.lit(60)), part(3)), F.lit(1000)), frac)
    return F.when(s.rlike(m), total)


_BLOCK = re.compile(r"\{([^}]*)\}")
_DRAW = re.compile(r"\\p(\d+)")


def plain_text(raw: str) -> str:
    """Without override blocks and drawings; an unclosed brace is text; \\N and \\n are line ends, \\h a space."""
    out, drawing, at = [], False, 0
    for m in _BLOCK.finditer(raw):
        if not drawing:
            out.append(raw[at : m.start()])
        modes = _DRAW.findall(m.group(1))
        if modes:
            drawing = int(modes[-1]) != 0
        at = m.end()
    if not drawing:
        out.append(raw[at:])
    return re.sub(r"\\[Nn]", "\n", "".join(out)).replace("\\h", " ").strip()


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda x: plain_text(x) if x is not None else None)


def parse_ass(files: DataFrame) -> DataFrame:
    """(clip_id, text) -> cues by start, from [Events] only, with columns as the last Format line before says.

    Section and format are the last ones seen: window functions over a file's lines. Text has to be the last column.
    """
    lines = files.select("clip_id", F.posexplode(F.split(_unix(F.col("text")), "\n")).alias("n", "raw")).withColumn("line", trim(F.col("raw")))
    w = Window.partitionBy("clip_id").orderBy("n")
    section = F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower("line")), ignorenulls=True).over(w)
    events = lines.withColumn("section", section).where("section = '[events]'")
    names = F.transform(F.split(F.regexp_replace(F.lower("line"), r"^format:", ""), ","), lambda x: trim(x))
    names = F.split(F.regexp_replace(F.array_join(names, ","), ",+$", ""), ",")
    events = events.withColumn("cols", F.last(F.when(F.lower("line").startswith("format:"), names), ignorenulls=True).over(w))
    d = events.where(F.lower("line").startswith("dialogue:")).where("element_at(cols, -1) = 'text' and array_contains(cols, 'start') and array_contains(cols, 'end')")
    # the split into as many fields as there are columns leaves the text's own commas
    body = F.regexp_replace("line", r"(?i)^dialogue:\s*", "")
    f = d.withColumn("fields", F.split(body, ",", F.size("cols"))).where("size(fields) = size(cols)")
    field = lambda name: F.element_at("fields", F.array_position("cols", name).cast("int"))
    c = f.select("clip_id", "n", ass_ms(field("start")).alias("start_ms"), ass_ms(field("end")).alias("end_ms"), _plain(F.element_at("fields", -1)).alias("text"))
    good = c.where("start_ms is not null and end_ms > start_ms and text != ''")
    return good.select("clip_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms", "n")) - 1).alias("pos"), "start_ms", "end_ms", "text")


def sidecars(videos: DataFrame, listing: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(path) x (path, text) -> videos with the text of the first extension that exists beside them, or null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./\\]*$", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    order = F.array_position(F.array(*[F.lit(x) for x in extensions]), ext)
    own = listing.withColumn("stem", stem(F.col("path"))).withColumn("o", order).where("o > 0").groupBy("stem").agg(F.min_by("text", "o").alias("subtitles"))
    return videos.withColumn("stem", stem(F.col("path"))).join(own, "stem", "left").drop("stem")
