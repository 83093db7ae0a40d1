"""Suggestion telemetry in batch: recent events, lifecycles, statistics, timelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("accepted", "partially_accepted", "rejected", "ignored")


def checked(hours: int, limit: int = 1) -> None:
    if not 0 < hours <= 720 or not 0 < limit <= 1000:
        raise ValueError("hours up to 720, limit up to 1000")


def trailing(events: DataFrame, hours: int, now=None, model: str | None = None) -> DataFrame:
    """Events of the last ``hours`` before ``now`` (by default the newest event)."""
    checked(hours)
    now = F.lit(now) if now is not None else F.lit(events.agg(F.max("timestamp")).first()[0])
    found = events.filter(F.col("timestamp") >= now - F.make_dt_interval(hours=F.lit(hours)))
    return found.filter(F.col("model") == model) if model else found


def recent(events: DataFrame, limit: int = 100, model: str | None = None) -> DataFrame:
    """The newest events, of one model if told so."""
    checked(1, limit)
    return (events.filter(F.col("model") == model) if model else events).orderBy(F.desc("id")).limit(limit)


def lifecycle(events: DataFrame, latest_wins: bool = False) -> DataFrame:
    """A row a suggestion that was shown: the newest showing's figures and its outcome, which the
    oldest other event decides (with ``latest_wins`` the newest)."""
    pick = F.max_by if latest_wins else F.min_by
    shown = F.when(F.col("event_type") == "suggested", F.col("id"))
    other = F.when(F.col("event_type").isin(*OUTCOMES), F.col("id"))
    x = events.filter("suggestion_id IS NOT NULL").groupBy("suggestion_id").agg(
        F.max("id").alias("newest"), F.max(shown).alias("_shown"), F.max_by(F.struct("latency_ms", "confidence", "model"), shown).alias("s"),
        F.coalesce(pick(F.when(other.isNotNull(), F.col("event_type")), other), F.lit("ignored")).alias("outcome"), F.count("*").alias("n_events"),
    )
    return x.filter("_shown IS NOT NULL").select("suggestion_id", "newest", "s.latency_ms", "s.confidence", "s.model", "outcome", "n_events")


def statistics(events: DataFrame) -> DataFrame:
    """Counts, means, rates and latency quantiles (element n div 2, and int(0.95 n)) by model."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    shown = F.col("event_type") == "suggested"
    engaged = F.col("event_type").isin("accepted", "partially_accepted", "rejected")
    stats = events.groupBy("model").agg(
        *[n(t).alias(t) for t in ("suggested", *OUTCOMES)], F.round(F.avg(F.when(shown, F.col("confidence"))), 6).alias("avg_confidence"),
        F.count_distinct(F.when(engaged, F.col("suggestion_id"))).alias("engaged"),
    )
    quantiles = _latency_quantiles(events.filter(shown & F.col("latency_ms").isNotNull()))
    rate = lambda a: F.when(F.col("suggested") > 0, F.round(F.col(a) / F.col("suggested"), 4)).otherwise(0.0)
    return stats.join(quantiles, "model", "left").na.fill(0.0, ["p50", "p95"]).withColumn("acceptance", rate("accepted")).withColumn("engagement", rate("engaged"))


def _latency_quantiles(shown: DataFrame) -> DataFrame:
    """``model, p50, p95``. Whole milliseconds are counted first, map-side; then only the latencies of
    the millisecond that holds a wanted rank are put in order."""
    shown = shown.select("model", "latency_ms", F.floor("latency_ms").alias("bin"))
    by = Window.partitionBy("model")
    bins = shown.groupBy("model", "bin").agg(F.count("*").alias("c"))
    bins = bins.withColumn("before", F.sum("c").over(by.orderBy("bin")) - F.col("c")).withColumn("n", F.sum("c").over(by))
    ranks = {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)}
    wanted = bins.withColumn("q", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), k.alias("k")) for name, k in ranks.items()])))
    wanted = wanted.filter("q.k >= before AND q.k < before + c").select("model", "bin", "q.name", (F.col("q.k") - F.col("before")).alias("k"))
    near = shown.join(wanted, ["model", "bin"]).groupBy("model", "name", "k", "latency_ms").agg(F.count("*").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("model", "name").orderBy("latency_ms"))).filter("upto > k")
    return near.groupBy("model").agg(*[F.round(F.min(F.when(F.col("name") == name, F.col("latency_ms"))), 1).alias(name) for name in ranks])


def timeline(events: DataFrame, hours: int) -> DataFrame:
    bucket = F.date_trunc("minute" if hours <= 1 else "hour", "timestamp")
    return events.groupBy(bucket.alias("bucket"), "model").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "suggested").alias("suggested"))


def ignored(events: DataFrame) -> DataFrame:
    """Suggestions still open when the session's next suggestion came (partial acceptance keeps one open)."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    x = events.filter(F.col("event_type").isin("suggested", "accepted", "rejected")).withColumn("next", F.lead("event_type").over(w)).withColumn("ignored_at", F.lead("timestamp").over(w))
    return x.filter("event_type = 'suggested' AND next = 'suggested'").select("session_id", F.col("id").alias("suggested_id"), "ignored_at")


def settled(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Debounce: events with no other in their session within the gap after them."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    wait = F.lead("timestamp").over(w).cast("double") - F.col("timestamp").cast("double")
    return events.withColumn("_wait", wait).filter(F.col("_wait").isNull() | (F.col("_wait") >= gap_seconds)).drop("_wait")


def redacted(suggestion, opted_in, most: int = 500):
    return F.when(opted_in, F.left(suggestion, F.lit(most)))


def short_model(name):
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.gguf$", "")


def normal_time(raw: Column) -> Column:
    """A timestamp of whole seconds from ISO text: 'T' or a space, a fraction and a 'Z' or none."""
    return F.to_timestamp(F.replace(F.regexp_replace(raw, r"(\.\d*)?Z?$", ""), F.lit("T"), F.lit(" ")))


def contexts(events: DataFrame) -> DataFrame:
    """``suggestion_id, context`` of suggestions that were shown: the newest showing's, or, where that is
    empty, the newest acceptance's."""
    at = lambda kind: F.max_by("context", F.when(F.col("event_type") == kind, F.col("id")))
    x = events.filter("suggestion_id IS NOT NULL").groupBy("suggestion_id").agg(at("suggested").alias("shown"), at("accepted").alias("taken"))
    return x.filter("shown IS NOT NULL").select("suggestion_id", F.coalesce(F.nullif("shown", F.lit("")), "taken").alias("context"))


def grid(events: DataFrame) -> DataFrame:
    """``bucket, model, n`` with a row for every bucket and every model that there are."""
    counts = events.groupBy("bucket", "model").agg(F.count("*").alias("n"))
    models = counts.agg(F.array_sort(F.collect_set("model")).alias("models"))  # a short list
    days = counts.select("bucket").distinct().join(F.broadcast(models)).select("bucket", F.explode("models").alias("model"))
    return days.join(counts, ["bucket", "model"], "left").select("bucket", "model", F.coalesce("n", F.lit(0)).alias("n"))


def flushed(events: DataFrame, most: int = 20, seconds: float = 5.0) -> DataFrame:
    """Events with the ``batch`` of their session that a client would send them in: one closes at ``most``
    events, or before an event that comes ``seconds`` or more after its first. A session is folded in order."""
    schema = events.select("session_id", "id", "timestamp").schema.add("batch", "long")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "id"])
        batch, count, began, out = 0, 0, None, []
        for at in pdf.timestamp:
            if began is not None and (count == most or (at - began).total_seconds() >= seconds):
                batch, count, began = batch + 1, 0, None
            began = at if began is None else began
            count += 1
            out.append(batch)
        return pdf.assign(batch=out)

    return events.select("session_id", "id", "timestamp").groupBy("session_id").applyInPandas(fold, schema)


def cycled(steps: DataFrame, user: str, order: str) -> DataFrame:
    """``depth`` and ``shown`` after each of ``steps(forward)`` of a user's walk through alternatives. A step
    forward fetches a new one, which is its row's own ``order``, and puts it on the history; a
    step back shows the one before it, and at the begin (null) does nothing."""
    w = Window.partitionBy(user).orderBy(order)
    up = F.when(F.col("forward"), 1).otherwise(-1)
    x = steps.withColumn("_sum", F.sum(up).over(w))
    # a walk that can't go below zero: the running sum over its own least value so far
    x = x.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    # what stands at a depth is what the last step forward put there
    put = F.last(F.when(F.col("forward"), F.col(order)), ignorenulls=True).over(Window.partitionBy(user, "depth").orderBy(order))
    return x.withColumn("shown", F.when(F.col("depth") > 0, put)).drop("_sum")
