"""Streaming jobs run to the end of their input: files in, micro-batches, a table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.corpus import table
from tallgrass.sources.shared import new_path
from tallgrass.sources.telemetry import telemetry
from tallgrass.streaming.sessions import live_batches, live_ignored
from tallgrass.streaming.telemetry import ignored_suggestions, settled_changes, windowed_counts


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # as a pattern it may name a file or a folder
    return telemetry(spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 8).parquet(path))


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All available input through ``stream``; each micro-batch is appended to a table."""
    base = new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out")
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")  # noqa: E731  a replayed batch replaces itself
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/epoch=*")


def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of all events, in whatever order the files hold them; of a window's updates the last (largest) count stands."""
    found = _run(spark, windowed_counts(_source(spark, sf_dir), late=None), "update")
    return found.groupBy("bucket", "model", "event_type").agg(F.max("n").alias("n"))


def run_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored suggestions of all events, in whatever order the files hold them."""
    return settled_changes(_run(spark, ignored_suggestions(_source(spark, sf_dir).select("id", "timestamp", "session_id", "event_type")), "append"))


def run_live_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored suggestions as a live job with a delay of two days says them: those whose events are older than that."""
    return _run(spark, live_ignored(_source(spark, sf_dir), "2 days"), "append")


def run_live_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' batches of five events or a day, as a live job with a delay of two days closes them."""
    return _run(spark, live_batches(_source(spark, sf_dir), 5, 86_400.0, "2 days"), "append")
