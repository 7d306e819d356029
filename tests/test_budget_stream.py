"""Budgets as streams against one plain account, over many micro-batches, restarts and dropped reservations."""

import random
import time

from cutgrain.streaming.budgets import admissions

EVENTS = "run string, at long, kind string, clip_id long, amount long, cached boolean, stops string"


def account(events, cap):
    """Decisions on a run's events, by a plain walk."""
    spent, held, waiting, seen, stopped, cancelled, out = 0, {}, [], set(), None, False, []

    def ask(at, clip, bound):
        nonlocal stopped
        if spent + bound > cap:
            out.append((at, clip, "over_budget", None))
            if stopped is None:
                stopped = "over_budget"
                out.append((at, None, "stopped", stopped))
        elif spent + sum(held.values()) + bound <= cap:
            held[clip] = bound
            out.append((at, clip, "admitted", None))
        else:
            return False
        return True

    for _, at, kind, clip, amount, cached, stops in sorted(events, key=lambda e: e[1]):
        if kind == "request" and clip not in seen:
            seen.add(clip)
            if cached and not cancelled:
                out.append((at, clip, "cached", None))
            elif stopped:
                out.append((at, clip, "not_started", None))
            elif not ask(at, clip, amount):
                waiting.append((at, clip, amount))
        elif kind in ("settle", "release") and clip in held:
            del held[clip]
            spent += amount if kind == "settle" else 0
            if kind == "settle" and stops and stopped is None:
                stopped = stops
                out.append((at, None, "stopped", stops))
            waiting = [w for w in waiting if not ask(*w)]
        elif kind == "cancel":
            cancelled = True
            if stopped != "cancelled":
                stopped = "cancelled"
                out.append((at, None, "stopped", stopped))
            out += [(a, c, "cancelled", None) for a, c, _ in waiting]
            waiting = []
    return out


def events_of(run, seed, n, cancel=None, fails=None, most=25):
    r, out, asked = random.Random(seed), [], []
    for at in range(n):
        if at == cancel:
            out.append((run, at, "cancel", None, None, None, None))
        elif r.random() < 0.5 or not asked:
            asked.append(len(asked))
            out.append((run, at, "request", asked[-1], r.randint(0, 60), r.random() < 0.15, None))
        else:
            clip = r.choice(asked[-6:])
            kind = "settle" if r.random() < 0.8 else "release"
            out.append((run, at, kind, clip, r.randint(0, most), None, "the key was rejected" if at == fails else None))
    return out


def run_stream(spark, source, out, mark, cap, give_up_s=600.0):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a query with timers would go on without data for ever
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    admissions(stream, cap, give_up_s).writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_streams_decide_as_one_account(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    runs = {"a": events_of("a", 1, 130, most=60), "b": events_of("b", 2, 60, cancel=41), "c": events_of("c", 3, 60, fails=30), "d": events_of("d", 4, 60, cancel=20, fails=9)}
    settles = [i for i, e in enumerate(runs["c"]) if e[2] == "settle"]
    runs["c"] = [(*e[:6], "the key was rejected") if i in settles[6:] else e for i, e in enumerate(runs["c"])]
    every = sorted((e for es in runs.values() for e in es), key=lambda e: e[1])
    parts = [every[:80], every[80:150], every[150:]]
    for i, part in enumerate(parts):  # each part in another start of the query; requests of the first come again with the second
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if i == 1:
            repeated = [(e[0], 70, *e[2:]) for e in parts[0] if e[2] == "request"]
            spark.createDataFrame(repeated, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, out, mark, 100)
    got = spark.read.parquet(out).collect()
    for run, events in runs.items():
        want = account(events, 100)
        assert sorted(map(repr, ((r.at, r.clip_id, r.decision, r.reason) for r in got if r.run == run))) == sorted(map(repr, want)), run
    assert {"admitted", "cached", "over_budget", "not_started", "cancelled", "stopped"} <= {r.decision for r in got}


def test_what_nobody_ends_is_dropped(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    first = [("a", 1, "request", 1, 80, False, None), ("a", 2, "request", 2, 90, False, None)]
    spark.createDataFrame(first, EVENTS).coalesce(1).write.parquet(source)
    run_stream(spark, source, out, mark, 100, 0.5)
    time.sleep(1)
    spark.createDataFrame([("z", 9, "request", 9, 1, False, None)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, mark, 100, 0.5)
    got = {(r.run, r.clip_id, r.decision) for r in spark.read.parquet(out).collect()}
    assert {("a", 1, "admitted"), ("a", 1, "dropped"), ("a", 2, "admitted"), ("z", 9, "admitted")} <= got
