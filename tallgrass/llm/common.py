"""Plumbing that the training-data operators share: inputs, staged tables, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` of the contracts sees it.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's own readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs locally (a test) a temporary one is chosen;
    on a cluster a missing setting is an error, for executors would not share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallgrass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and
    a lost executor costs a re-read rather than a recomputation. The folder's path
    goes to ``paths``, for those who ``discard`` it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str], shuffles: bool = False) -> None:
    """Deletes staged tables that no later table or result reads. With ``shuffles`` Spark's cleaner
    also finds the shuffles that made them: it drops the files of those that are garbage."""
    if shuffles and paths:
        gc.collect()
        spark._jvm.System.gc()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart (half a SHA-256); null has its own."""
    text = text.cast("string")
    return F.unhex(F.substring(F.sha2(F.when(text.isNull(), "null").otherwise(F.concat(F.lit("="), text)), 256), 1, 32))


def added(columns: list[str], *names: str) -> list[str]:
    """Names for added columns: each with as many underscores more as keep it apart from the given columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that carry whole texts into Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(column: Column) -> Column:
    """The sum of an array of numbers, as a long."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions as the session sets them."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def store_of(uri: str):
    """The file system of a URI and the path in it, for executors that write or read whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def task_number() -> int:
    """The number of the partition that this task makes."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
