"""Live per-session operators on arbitrary state: events wait in the state until the watermark has
passed them, are then taken in order, and leave it. State is bounded by the allowed delay.

An event that comes later than the delay allows is dropped by Spark before the state sees it
(``numRowsDroppedByWatermark`` counts them); one with a missing time or session never enters.
Results come once the watermark has passed the events that make them, never to be undone.
The state is in RocksDB, and a query that is started again from its checkpoint goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING_KEY, _WAITING = "at long, id long", "kind string"


class InOrder(StatefulProcessor):
    """Keeps a key's events in a map state by time and id, with one event-time timer for the earliest,
    and hands them to ``take`` in order once the watermark is past them.

    ``take(session, events)`` gets ``(micros, id, kind)`` and yields output rows; ``idle(session, now)`` is
    asked when the watermark passes a time that ``take`` asked for through ``self.wake``."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _WAITING_KEY, _WAITING)
        self.timer = handle.getValueState("timer", "at long")
        self.open_states(handle)

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        """States of an operator's own."""

    def take(self, session, events: list[tuple[int, int, str]]) -> Iterator[tuple]:
        raise NotImplementedError

    def idle(self, session, now: int) -> Iterator[tuple]:
        return iter(())

    def wake(self) -> int | None:
        """The millisecond after which ``idle`` is to be asked, if any."""
        return None

    def _next_timer(self, first: int | None) -> None:
        wanted = min((t for t in (first, self.wake()) if t is not None), default=None)
        now = self.timer.get()[0] if self.timer.exists() else None
        if wanted == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for at, event, kind in zip(batch["at"].tolist(), batch["id"].tolist(), batch["kind"].tolist(), strict=True):
                self.waiting.updateValue((at, event), (kind,))
                first = at if first is None else min(first, at)
        if first is not None:
            known = self.timer.get()[0] if self.timer.exists() else None
            due = first // 1000 + 1
            self._next_timer(due if known is None else min(due, known))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], k[1]) for k in self.waiting.keys())
        ready = [k for k in held if k[0] // 1000 < now]
        events = [(at, event, self.waiting.getValue((at, event))[0]) for at, event in ready]
        for k in ready:
            self.waiting.removeKey(k)
        out = list(self.take(key[0], events))
        out += self.idle(key[0], now)
        self.timer.clear()  # the one that has just expired
        self._next_timer(held[len(ready)][0] // 1000 + 1 if len(held) > len(ready) else None)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Outstanding(InOrder):
    """A session has one open suggestion at most: the next one shown makes it ignored, accepting or
    rejecting closes it, a partial acceptance does not."""

    columns = ["session_id", "suggested_id", "at"]

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "id long")

    def take(self, session, events):
        shown = self.shown.get()[0] if self.shown.exists() else None
        for at, event, kind in events:
            if kind == "suggested":
                if shown is not None:
                    yield session, shown, at
                shown = event
            else:
                shown = None
        if shown is None:
            self.shown.clear()
        else:
            self.shown.update((shown,))


class Buffered(InOrder):
    """A client's buffer: a batch is sent when it holds ``most`` events or ``seconds`` after its first,
    also when no other event comes."""

    columns = ["session_id", "batch", "n", "first", "last"]

    def __init__(self, most: int = 20, seconds: float = 5.0):
        self.most, self.wait = most, int(seconds * 1_000_000)

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        self.begun = handle.getValueState("begun", "batch long, n long, first long, last long")

    def _held(self) -> tuple[int, int, int, int]:
        return tuple(self.begun.get()) if self.begun.exists() else (0, 0, 0, 0)

    def take(self, session, events):
        batch, n, first, last = self._held()
        for at, _, _ in events:
            if n and (n == self.most or at - first >= self.wait):
                yield session, batch, n, first, last
                batch, n = batch + 1, 0
            first, last, n = first if n else at, at, n + 1
        if n == self.most:
            yield session, batch, n, first, last
            batch, n = batch + 1, 0
        self.begun.update((batch, n, first, last))

    def wake(self) -> int | None:
        _, n, first, _ = self._held()
        return (first + self.wait) // 1000 + 1 if n else None

    def idle(self, session, now: int):
        batch, n, first, last = self._held()
        if n and (first + self.wait) // 1000 < now:
            self.begun.update((batch + 1, 0, 0, 0))
            yield session, batch, n, first, last


def _keyed(events: DataFrame, late: str) -> DataFrame:
    known = events.filter("timestamp IS NOT NULL AND session_id IS NOT NULL").withWatermark("timestamp", late)
    return known.select("session_id", "timestamp", F.unix_micros("timestamp").alias("at"), F.col("id").cast("long").alias("id"), F.col("event_type").alias("kind"))


def with_rocks(spark: SparkSession) -> None:
    """Arbitrary state needs this store; a session that already names one keeps it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live_ignored(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``session_id, suggested_id, ignored_at`` of a stream of events, each once its time is final."""
    with_rocks(events.sparkSession)
    kind = events.schema["session_id"].dataType.simpleString()
    kept = _keyed(events.filter(F.col("event_type").isin("suggested", "accepted", "rejected")), late)
    found = kept.groupBy("session_id").transformWithStateInPandas(Outstanding(), f"session_id {kind}, suggested_id long, at long", "append", "eventtime")
    return found.select("session_id", "suggested_id", F.timestamp_micros("at").alias("ignored_at"))


def live_batches(events: DataFrame, most: int = 20, seconds: float = 5.0, late: str = "1 hour") -> DataFrame:
    """``session_id, batch, n, first, last``: the batches that clients would send, each once it is closed."""
    with_rocks(events.sparkSession)
    kind = events.schema["session_id"].dataType.simpleString()
    found = _keyed(events, late).groupBy("session_id").transformWithStateInPandas(Buffered(most, seconds), f"session_id {kind}, batch long, n long, first long, last long", "append", "eventtime")
    return found.select("session_id", "batch", "n", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"))
