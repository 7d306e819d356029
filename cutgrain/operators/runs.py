"""A whole run: what is cached is served, the rest goes to a provider, answers are parsed, and each clip has an outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.operators.answers import parse_answers
from cutgrain.operators.budget import charge
from cutgrain.operators.scans import ranges
from cutgrain.session import unused
from cutgrain.sources.cache import cached_answers

LONGEST_S = 1800.0


def describe_clips(clips: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame], longest_s: float = LONGEST_S, force: bool = False, important: bool = True) -> DataFrame:
    """(clip_id, duration_s, identity, settings) -> (clip_id, outcome, error, summary, segments, main), cached clips' own among them.

    provider takes the clips that need an answer and returns them with (body, stop_reason): a join with recorded answers, or
    a mapInPandas over a client. A cached clip is served whatever its
    length, as only describing measures it; other clips that are too long never reach the provider. force leaves the cache unread.
    """
    known = cached_answers(clips, cache.limit(0) if force else cache)
    known = known.withColumn("way", F.when(F.col("cached"), "cached").when(F.col("duration_s") > longest_s, "too_long").otherwise("ask"))
    parsed = parse_answers(provider(known.where("way = 'ask'").select("clip_id", "duration_s")), important)
    got = known.select("clip_id", "way", "cached_clip").join(parsed, "clip_id", "left")
    outcome = F.when(F.col("way") != "ask", F.col("way")).when(F.col("summary").isNotNull(), "described").when(F.col("error").isNotNull(), "failed").otherwise("not_started")
    said = [F.when(F.col("way") == "cached", F.col("cached_clip")[c]).otherwise(F.col(c)).alias(c) for c in ("summary", "segments", "main")]
    return got.select("clip_id", outcome.alias("outcome"), "error", *said)


def recorded(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider that joins recorded answers (clip_id, body, stop_reason)."""
    return lambda clips: clips.join(answers, "clip_id")


def finish_runs(clips: DataFrame, keys: list[str], order: list[str], cap: Column) -> DataFrame:
    """What becomes of each clip of runs that may stop, one clip after the other: the rows with `spent_before`, `outcome` and `stops`.

    (keys, order, way cached | too_long | ask, bound, actual, error_kind, stops_run, cancelled): bound is what a request may cost
    and actual what it did, in whole units; error_kind and stops_run are those of the reply, null for a good one; cancelled says
    that the run was cancelled while this clip was in work. outcome is described, cached, failed, over_budget, cancelled or
    not_started, and stops is why the run stopped at this clip: `cancelled`, `over_budget` or stops_run.

    A request is sent while what was charged before and its bound stay within cap; the first that isn't stops the run, as do
    errors that would fail every clip and a cancel. After a stop, clips that are cached are served and nothing is sent; after a
    cancel nothing is served either. A run of any length is many tasks: sums and stops carry over between ranges of the order.
    """
    spent, stops, cancels, asks = unused(clips, "spent_before", "stops_before", "cancels_before", "asks")
    ask = F.col("way") == "ask"
    cost = F.when(ask, charge(F.col("error_kind"), F.col("bound"), F.col("actual"))).otherwise(F.lit(0)).cast("bigint")
    cancelled = F.coalesce(F.col("cancelled"), F.lit(False))
    got = ranges(clips, [*keys, *order]).total(keys, cost, spent)
    over = ask & (F.col(spent) + F.col("bound") > cap)
    why = F.when(over, "over_budget").when(cancelled, "cancelled").when(ask & F.col("error_kind").isNotNull(), F.col("stops_run"))
    got = got.with_rows(got.rows.withColumns({asks: why, "cancelled": cancelled}))
    got = got.total(keys, F.col(asks).isNotNull().cast("bigint"), stops).total(keys, F.col("cancelled").cast("bigint"), cancels).drop()
    running = F.col(stops) == 0
    tried = F.when(F.col("way") == "cached", "cached").when(F.col("way") == "too_long", "failed").when(F.col(asks) == "over_budget", "over_budget").when(F.col("cancelled"), "cancelled").when(F.col("error_kind").isNull(), "described").otherwise("failed")
    served = F.when((F.col("way") == "cached") & (F.col(cancels) == 0), "cached").otherwise("not_started")
    reason = F.when(F.col("cancelled"), "cancelled").when(running, F.col(asks))
    return got.withColumns({"outcome": F.when(running, tried).otherwise(served), "stops": reason}).drop(stops, cancels, asks)


def run_ends(finished: DataFrame, keys: list[str]) -> DataFrame:
    """finish_runs() -> (keys, stopped, clips, left, billed): why each run stopped, how many clips it has and how many of these are
    neither described nor cached, and what its requests were billed, bad answers included. A cancel overrides an earlier reason,
    and a run that did everything hasn't stopped."""
    done = F.col("outcome").isin("described", "cached")
    billed = (F.col("outcome") == "described") | ((F.col("outcome") == "failed") & (F.col("way") == "ask") & (F.col("error_kind") == "bad_answer"))
    got = finished.groupBy(*keys).agg(
        F.max(F.when(F.col("stops") == "cancelled", "cancelled")).alias("c"),
        F.max(F.when(F.col("stops") != "cancelled", F.col("stops"))).alias("s"),
        F.count("*").alias("clips"),
        F.count_if(~done).alias("left"),
        F.sum(F.when(billed, F.col("actual")).otherwise(0)).alias("billed"),
    )
    return got.select(*keys, F.when(F.col("left") > 0, F.coalesce("c", "s")).alias("stopped"), "clips", "left", "billed")
