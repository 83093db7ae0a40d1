"""Streaming forms: the line filter, event counts by window, and the outstanding suggestion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallgrass.functions import text

#: Stands for a missing time, after all others.
NEVER = (1 << 63) - 1


def filter_lines(lines: DataFrame) -> DataFrame:
    """Quick cleaning of a stream of ``value`` lines; discarded ones go."""
    return lines.select(text.quick_clean(F.col("value")).alias("value")).filter("value <> ''")


def windowed_counts(events: DataFrame, late: str | None = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts by window, model and type; events later than ``late`` are left out. With None
    every event counts, in any order, and the counts of all windows stay in the state."""
    kept = events.withWatermark("timestamp", late) if late else events
    return kept.groupBy(F.window("timestamp", size), "model", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "model", "event_type", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def quiet_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Bursts of a session: the last event before a quiet ``gap`` fires."""
    return events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "session_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("fired")).select("session_id", "fired", "n")


def ignored_suggestions(events: DataFrame) -> DataFrame:
    """Stateful: a new suggestion while one is open makes the open one ignored; accepted or
    rejected closes it, a partial acceptance doesn't.

    Events may come in any order: the state keeps those of a session that open or close, as
    triples of time, id and kind. A late one may undo what was said, so rows carry a
    ``change`` of their count, above or below zero; ``settled_changes`` adds them up.
    """

    def pairs(log: np.ndarray) -> Counter:
        now, after = log[:-1], log[1:]
        hit = (now[:, 2] == 1) & (after[:, 2] == 1)
        return Counter(zip(now[hit, 1].tolist(), after[hit, 0].tolist(), strict=True))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = np.frombuffer(bytes(state.get[0]), np.int64).reshape(-1, 3) if state.exists else np.zeros((0, 3), np.int64)
        log = np.concatenate([old, *(b[["at", "id", "opens"]].to_numpy(np.int64) for b in batches)])
        log = log[np.lexsort((log[:, 1], log[:, 0]))]
        state.update((log.tobytes(),))
        change = pairs(log)
        change.subtract(pairs(old))
        yield pd.DataFrame([(key[0], i, at, n) for (i, at), n in change.items() if n], columns=["session_id", "suggested_id", "at", "change"])

    kept = events.filter(F.col("event_type").isin("suggested", "accepted", "rejected"))
    kept = kept.select("session_id", "id", F.coalesce(F.unix_micros("timestamp"), F.lit(NEVER)).alias("at"), (F.col("event_type") == "suggested").cast("long").alias("opens"))
    found = kept.groupBy("session_id").applyInPandasWithState(step, "session_id long, suggested_id long, at long, change long", "log binary", "append", GroupStateTimeout.NoTimeout)
    return found.select("session_id", "suggested_id", F.timestamp_micros(F.nullif("at", F.lit(NEVER))).alias("ignored_at"), "change")


def settled_changes(changes: DataFrame) -> DataFrame:
    """The ignored suggestions that remain when all of ``ignored_suggestions``' changes are added up."""
    key = ["session_id", "suggested_id", "ignored_at"]
    left = changes.groupBy(*key).agg(F.sum("change").cast("int").alias("n")).filter("n > 0")
    return left.select(*key, F.explode(F.array_repeat(F.lit(0), F.col("n")))).select(*key)
