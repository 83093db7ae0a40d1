"""The driver's event table seen as suggestion telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"view": "suggested", "purchase": "accepted", "click": "partially_accepted", "error": "rejected", "signup": "ignored"}


def telemetry(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("session_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.element_at(kind, F.col("event_type")).alias("event_type"),
        F.expr("event_id div 3").alias("suggestion_id"), F.col("value").alias("latency_ms"), (F.col("value") / (F.col("value") + 50)).alias("confidence"),
        F.get_json_object("props", "$.k").cast("int").alias("prompt_length"),
    )
