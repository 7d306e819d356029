"""Admission under a budget, and what a run's clips come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.operators.scans import ranges
from cutgrain.session import unused


def serial_budget(clips: DataFrame, cap: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, bound, actual) -> with `spent_before` and `outcome`: a clip is admitted while what was spent before it and
    its own bound stay within the cap; the first that isn't stops the run of its key. Sums carry over between ranges of the
    order, so a key of any size is many tasks. Null amounts count as 0, and a null bound or cap stops nothing."""
    spent, over, stops = unused(clips, "spent_before", "over", "stops")
    got = ranges(clips, [*keys, *order]).total(keys, F.col("actual"), spent)
    got = got.with_rows(got.rows.withColumn(over, (F.col(spent) + F.col("bound") > cap).cast("int"))).total(keys, F.col(over), stops).drop()
    outcome = F.when((F.col(stops) == 0) & (F.col(over) == 0), "admitted").when(F.col(stops) == 0, "stopped").otherwise("not_started")
    return got.withColumn("outcome", outcome).drop(over, stops)


def serve_after_stop(clips: DataFrame) -> DataFrame:
    """After a stop, clips with a cached answer are still served: (outcome, cached boolean) -> outcome."""
    return clips.withColumn("outcome", F.when(F.col("outcome").isin("stopped", "not_started") & F.col("cached"), "cached").otherwise(F.col("outcome")))


def charge(error_kind: Column, bound: Column, actual: Column) -> Column:
    """What an attempt costs: its usage where it was read, the whole bound where that can't be known, else nothing."""
    return F.when(error_kind.isNull() | (error_kind == "bad_answer"), actual).when(error_kind.isin("timeout", "unreadable"), bound).otherwise(F.lit(0.0))


def run_totals(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome, moments, cost_usd) -> counts and sums; cached clips cost nothing."""
    n = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return outcomes.groupBy(*keys).agg(
        n("described").alias("described"),
        n("cached").alias("cached"),
        n("failed").alias("problems"),
        n("not_started").alias("not_tried"),
        F.sum(F.when(F.col("outcome").isin("described", "cached"), F.col("moments")).otherwise(0)).alias("moments"),
        F.sum(F.when(F.col("outcome").isin("described", "failed"), F.col("cost_usd")).otherwise(0.0)).alias("cost_usd"),
    )
