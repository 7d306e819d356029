"""Key frames: of each window of candidates, the one that changes most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutgrain.functions.pictures import fingerprint_diff


def change_scores(frames: DataFrame) -> DataFrame:
    """(clip_id, time_s, fp) -> with idx in time order and score, the difference to the frame before (0 for the first)."""
    w = Window.partitionBy("clip_id").orderBy("time_s")
    before = F.lag("fp").over(w)
    return frames.select("*", (F.row_number().over(w) - 1).alias("idx"), before.alias("__b")).withColumn("score", F.when(F.col("__b").isNull(), 0.0).otherwise(fingerprint_diff(F.col("fp"), F.col("__b")))).drop("__b")


def select_key_frames(scored: DataFrame, budget: Column, candidates: Column | None = None) -> DataFrame:
    """(clip_id, idx, score, ...) -> the rows chosen. n candidates in m = budget windows of indexes [w n / m, (w + 1) n / m):
    the highest score of each, the first of equal ones; all where n <= m. n is how many rows a clip has, or `candidates`: how
    many it was sampled at, where some of the last may be missing."""
    n = F.count("*").over(Window.partitionBy("clip_id")) if candidates is None else candidates.cast("bigint")
    s = scored.withColumn("m", budget.cast("bigint")).withColumn("n", n)
    slot = F.floor(((F.col("idx") + 1) * F.col("m") - 1) / F.greatest(F.col("n"), F.lit(1)))
    s = s.where("m > 0").withColumn("w", F.when(F.col("n") <= F.col("m"), F.col("idx")).otherwise(slot))
    best = Window.partitionBy("clip_id", "w").orderBy(F.col("score").desc(), "idx")
    return s.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "w", "n", "m")
