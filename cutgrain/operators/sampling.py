"""Which times of a clip are looked at: rows of (clip_id, duration_s, ...) become rows a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (seconds between frames, most frames) of the two fixed samplings.
FRAMES = (2.0, 60)
CANDIDATES = (0.5, 240)
LEAST_SHARE_S = 2.0


def frame_count(duration: Column, interval_s: float, most: int) -> Column:
    return F.when(duration <= 0, 0).when(duration < interval_s, 1).otherwise(F.least(F.ceil(duration / interval_s), F.lit(most))).cast("int")


def sample_times(duration: Column, interval_s: float = FRAMES[0], most: int = FRAMES[1]) -> Column:
    """array<double>: every interval, evenly when that is more than most; the middle of a shorter clip; none of an empty one."""
    n = frame_count(duration, interval_s, most)
    step = F.greatest(F.lit(interval_s), duration / most)
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)
    return F.when(n <= 0, F.expr("cast(array() as array<double>)")).when(duration < interval_s, F.array(duration / 2)).otherwise(every)


def sampled(clips: DataFrame, interval_s: float = FRAMES[0], most: int = FRAMES[1]) -> DataFrame:
    """(clip_id, duration_s) -> (clip_id, idx, time_s)."""
    return clips.select("clip_id", F.posexplode(sample_times(F.col("duration_s"), interval_s, most)).alias("idx", "time_s"))


def frame_budget(duration: Column, sampling: str) -> Column:
    """Most frames that a sampling may send: one a fixed interval, but for shots, of which a clip can have many, the most there are."""
    if sampling not in ("interval", "key_frames", "shots"):
        raise ValueError(f"unknown sampling {sampling!r}")
    return F.lit(FRAMES[1]) if sampling == "shots" else frame_count(duration, *FRAMES)


def needs_exact(got: Column, wanted: Column, before: Column, interval_s: float) -> Column:
    """Whether a frame that a seek to `wanted` gave must be sought again exactly: it isn't after the frame before (null: none), or
    more than half an interval off."""
    return F.coalesce(got <= before + 1e-3, F.lit(False)) | (F.abs(got - wanted) > interval_s / 2)


def shot_times(shots: DataFrame, budget: Column, most: int = FRAMES[1]) -> DataFrame:
    """(clip_id, pos, start_s, end_s) with a budget of frames -> (clip_id, pos, time_s): the middles of each shot's shares.

    Every shot gets a frame; of more than `most` shots the longest do (of equal ones the earlier). What is left of the
    budget goes one by one to the shot whose shares are longest while they stay at 2 s or more. A shot's k-th share is a
    row with priority length / k, which falls with k, so the greedy choice is the first rows by priority.
    """
    length = F.col("end_s") - F.col("start_s")
    by_length = Window.partitionBy("clip_id").orderBy(length.desc(), "pos")
    kept = shots.withColumn("budget", budget.cast("int")).withColumn("len", length).withColumn("__r", F.row_number().over(by_length)).where(F.col("__r") <= most)
    kept = kept.withColumn("spare", F.greatest(F.col("budget") - F.count("*").over(Window.partitionBy("clip_id")), F.lit(0)))
    more = kept.select("clip_id", "pos", "len", "spare", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("len") / LEAST_SHARE_S).cast("int")))).alias("k")).where(F.col("len") / (F.col("k") + 1) >= LEAST_SHARE_S)
    order = Window.partitionBy("clip_id").orderBy((F.col("len") / F.col("k")).desc(), "pos")
    won = more.withColumn("__o", F.row_number().over(order)).where(F.col("__o") <= F.col("spare")).groupBy("clip_id", "pos").agg(F.count("*").alias("extra"))
    counted = kept.join(won, ["clip_id", "pos"], "left").withColumn("n", (F.coalesce("extra", F.lit(0)) + 1).cast("int"))
    return counted.select("clip_id", "pos", "start_s", "len", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("clip_id", "pos", (F.col("start_s") + F.col("len") * (F.col("k") + 0.5) / F.col("n")).alias("time_s"))


def moment_times(at: Column, width: Column, duration: Column) -> Column:
    """Times around a moment, inside the clip, in order, those within a millisecond of the one before dropped."""
    w = F.greatest(width, F.lit(0.0))
    inside = F.array_sort(F.transform(F.array(at - w, at, at + w), lambda t: F.greatest(F.lit(0.0), F.least(t, duration))))
    return F.aggregate(inside, F.expr("cast(array() as array<double>)"), lambda a, t: F.when((F.size(a) > 0) & (t - F.coalesce(F.try_element_at(a, F.lit(-1)), t - 1) <= 0.001), a).otherwise(F.concat(a, F.array(t))))
