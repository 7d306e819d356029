"""A run's budget as a stream: requests are admitted, wait or end the run as events arrive, over any number of micro-batches.

A run's money is state of its key: what is spent, what requests in flight have set aside, who waits, and why the run stopped. The
state store keeps it with the query's checkpoint, so a query that starts again goes on where it was and a replayed batch finds
the state it had. Runs are independent; one run's events are taken one after the other, as one account must.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "run string, at long, clip_id long, decision string, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Account(StatefulProcessor):
    """One run's account. Amounts are whole units of money."""

    def __init__(self, cap: int | None, give_up_ms: int) -> None:
        self.cap, self.give_up_ms = cap, give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.money = handle.getValueState("money", "spent long, reserved long, stopped string, cancelled boolean")
        self.held = handle.getMapState("held", "clip_id long", "bound long, due long")
        self.waiting = handle.getMapState("waiting", "at long, clip_id long", "bound long")
        self.seen = handle.getMapState("seen", "clip_id long", "at long")

    def _load(self) -> None:
        self.spent, self.reserved, self.stopped, self.cancelled = self.money.get() if self.money.exists() else (0, 0, None, False)

    def _keep(self) -> None:
        self.money.update((self.spent, self.reserved, self.stopped, self.cancelled))

    def _say(self, at: int, clip: int | None, decision: str, reason: str | None = None) -> None:
        self.said.append((self.run, at, clip, decision, reason))

    def _stop(self, at: int, reason: str) -> None:
        """The first reason counts, but that a cancel overrides it."""
        if self.stopped is None or (reason == "cancelled" and self.stopped != "cancelled"):
            self.stopped = reason
            self._say(at, None, "stopped", reason)

    def _fits(self, amount: int) -> bool:
        return self.cap is None or amount <= self.cap

    def _ask(self, at: int, clip: int, bound: int, now: int) -> bool:
        """Whether the request is decided; what is set aside for others is all that it may wait for."""
        if not self._fits(self.spent + bound):
            self._say(at, clip, "over_budget")
            self._stop(at, "over_budget")
        elif self._fits(self.spent + self.reserved + bound):
            self.reserved += bound
            self.held.updateValue((clip,), (bound, now + self.give_up_ms))
            self.handle.registerTimer(now + self.give_up_ms)
            self._say(at, clip, "admitted")
        else:
            return False
        return True

    def _let_in(self, now: int) -> None:
        """Those that wait ask again, in order; one that still doesn't fit may be passed by a smaller one."""
        for key in sorted(tuple(k) for k in self.waiting.keys()):
            bound = self.waiting.getValue(key)[0]
            if self._ask(*key, bound, now):
                self.waiting.removeKey(key)

    def _free(self, clip: int) -> bool:
        if not self.held.containsKey((clip,)):
            return False
        self.reserved -= self.held.getValue((clip,))[0]
        self.held.removeKey((clip,))
        return True

    def _take(self, e, now: int) -> None:
        if e.kind == "request":
            if self.seen.containsKey((e.clip_id,)):
                return
            self.seen.updateValue((e.clip_id,), (e.at,))
            bound = max(0, e.amount)
            if e.cached and not self.cancelled:
                self._say(e.at, e.clip_id, "cached")
            elif self.stopped is not None:
                self._say(e.at, e.clip_id, "not_started")
            elif not self._ask(e.at, e.clip_id, bound, now):
                self.waiting.updateValue((e.at, e.clip_id), (bound,))
        elif e.kind == "settle" and self._free(e.clip_id):
            self.spent += max(0, e.amount)
            if e.stops is not None:
                self._stop(e.at, e.stops)
            self._let_in(now)
        elif e.kind == "release" and self._free(e.clip_id):
            self._let_in(now)
        elif e.kind == "cancel":
            self.cancelled = True
            self._stop(e.at, "cancelled")
            for key in sorted(tuple(k) for k in self.waiting.keys()):
                self._say(*key, "cancelled")
                self.waiting.removeKey(key)

    def _told(self) -> Iterator[pd.DataFrame]:
        self._keep()
        if self.said:
            yield pd.DataFrame(self.said, columns=["run", "at", "clip_id", "decision", "reason"]).astype({"clip_id": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.run, self.said = key[0], []
        self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
        events["stops"] = events["stops"].astype(object).where(events["stops"].notna(), None)
        for e in events.astype({"cached": "boolean"}).fillna({"cached": False, "amount": 0, "clip_id": -1}).astype({"amount": "int64", "clip_id": "int64", "at": "int64"}).itertuples():
            self._take(e, now)
        yield from self._told()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Reservations that nobody settled or released in time are dropped."""
        self.run, self.said = key[0], []
        self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [k[0] for k, v in self.held.iterator() if v[1] <= now]
        for clip in sorted(due):
            self._free(clip)
            self._say(now, clip, "dropped")
        self._let_in(now)
        yield from self._told()

    def close(self) -> None:
        pass


def admissions(events: DataFrame, cap: int | None, give_up_s: float = 600.0) -> DataFrame:
    """A stream (run, at, kind, clip_id, amount, cached, stops) -> a stream of DECISIONS, each clip's once.

    Events of a run count in the order of `at`, as far as a micro-batch has them. kind `request` asks for a clip with amount as its
    bound; `settle` replaces what was set aside by the real amount, with the reason if its error ends the run; `release` gives it
    back; `cancel` ends the run at once. A request is admitted while what is spent, what others have set aside and its bound
    stay within the cap. If only what others have set aside is in the way it waits, else it is over budget and ends the run.
    After the first reason to stop, new requests are served from the cache (`cached`) or not started; after a cancel nothing is
    served, and those that wait are cancelled. What is set aside for give_up_s without an end is dropped. A clip asks once:
    other requests for it are ignored, as are ends of what isn't in flight. Null amounts are 0. Needs the RocksDB state store,
    which this sets; timers need a trigger that goes on, so one that ends with the data needs noDataMicroBatches off.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("run").transformWithStateInPandas(Account(cap, int(give_up_s * 1000)), DECISIONS, "Append", "ProcessingTime")
