"""Sources and sinks: text folders, documents as lines, JSON, logs, vocabularies, telemetry."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators.stream import placed

TELEMETRY = (
    "id BIGINT, timestamp TIMESTAMP, session_id STRING, model STRING, event_type STRING, suggestion_id STRING, latency_ms DOUBLE, confidence DOUBLE, "
    "suggestion_length INT, prompt_length INT, suggestion_text STRING, context STRING, accepted_length INT, reject_reason STRING"
)
TARGETS = (
    "strategies ARRAY<STRUCT<name STRING, tests ARRAY<STRUCT<category STRING, input STRING, target_completion STRING, valid_suffixes ARRAY<STRING>>>, "
    "roots ARRAY<STRING>, cases ARRAY<STRUCT<`case` STRING, suffix STRING, description STRING, indefinite STRING>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, line_no, line``: one row a line of each document."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or of a folder's ``*.txt`` as ``source, line``, invalid UTF-8 replaced."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(path)
    return found.select(F.col("_metadata.file_name").alias("source"), F.make_valid_utf8("value").alias("line"))


def exclude_sources(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without sources whose name contains one of ``names``."""
    return reduce(lambda d, n: d.filter(~F.col("source").contains(n)), names, df)


def with_global_index(df: DataFrame) -> DataFrame:
    """A dense index in (doc_id, line_no) order: sizes by document are summed first and then where
    a range sort puts them, so that neither lines nor documents are gathered in one task."""
    sizes = placed(df.groupBy("doc_id").agg(F.count("*").alias("_n")), ["doc_id"], "_n").select("doc_id", "start")
    own = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return df.join(sizes, "doc_id").withColumn("line_idx", F.col("start") + own).drop("start")


def write_text(df: DataFrame, path: str, keep_blank: bool = True) -> None:
    """Cleaned lines by source."""
    (df if keep_blank else df.filter("line <> ''")).select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)


def read_targets(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """Tests of the first strategy of a name."""
    found = spark.read.schema(TARGETS).option("multiLine", True).json(path).select(F.posexplode("strategies").alias("pos", "s"))
    first = found.filter(F.col("s.name") == strategy).orderBy("pos").limit(1)
    return first.select(F.inline("s.tests")).withColumn("category", F.coalesce("category", F.lit("unknown")))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tail_log(spark: SparkSession, path: str, schema: str, limit: int = 100) -> DataFrame:
    """The newest well-formed entries."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("e")).filter("e IS NOT NULL")
    return rows.select("e.*").orderBy(F.desc("timestamp")).limit(limit)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``piece, score`` of a tab-separated vocabulary."""
    return spark.read.schema("piece STRING, score DOUBLE").option("sep", "\t").option("quote", "").csv(path)


def wiki_extracts(responses: DataFrame, least: int = 200) -> DataFrame:
    """Page texts out of MediaWiki responses in ``json``."""
    shape = "query STRUCT<pages: MAP<STRING, STRUCT<title: STRING, extract: STRING>>>"
    pages = responses.select(F.explode(F.map_values(F.from_json("json", shape)["query"]["pages"])).alias("p"))
    return pages.select("p.title", F.coalesce("p.extract", F.lit("(no extract)")).alias("extract")).filter(F.length("extract") > least)


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema evolution."""
    return old.unionByName(new, allowMissingColumns=True)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files by name, the first folder of a name winning, with megabytes."""
    parts = [spark.read.format("binaryFile").load(p).select(F.lit(k).alias("k"), "path", "length") for k, p in enumerate(paths)]
    named = reduce(DataFrame.unionByName, parts).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.groupBy("name").agg(F.min_by("path", "k").alias("path"), F.round(F.min_by("length", "k") / 1048576, 1).alias("mb"))


def concatenated(spark: SparkSession, path: str, exclude: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lines of a folder's texts without the excluded sources, and a report ``source, bytes, kept`` of all."""
    rows = read_text(spark, path)
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source"), F.col("length").alias("bytes"))
    dropped = reduce(lambda a, b: a | b, [F.col("source").contains(n) for n in exclude], F.lit(False))
    return exclude_sources(rows, exclude), sizes.withColumn("kept", ~dropped)


def write_tokens(lines: DataFrame, path: str) -> None:
    """Ids of ``lines(doc_id, line_no, ids)`` as an array a document, in one pass: Parquet needs no count beforehand."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "ids")))
    lines.groupBy("doc_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).cast("array<int>").alias("ids")).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id BIGINT, ids ARRAY<INT>").parquet(path)


def checked_tokens(spark: SparkSession, path: str, most: int = 65535) -> DataFrame:
    """``tokens, max_id, distinct_ids`` of a written table; an id above ``most`` is an error."""
    u = read_tokens(spark, path).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    got = u.agg(F.sum("n").alias("tokens"), F.max("id").alias("max_id"), F.count("*").alias("distinct_ids"))
    return got.withColumn("max_id", F.when(F.col("max_id") > most, F.raise_error(F.lit("an id does not fit two bytes")).cast("int")).otherwise(F.col("max_id")))


def token_windows(tokens: DataFrame, window: int) -> DataFrame:
    """``doc_id, k, x, y``: inputs and targets of each whole window of a document's ids."""
    count = F.floor((F.size("ids") - 1) / window).cast("int")
    w = tokens.filter(count > 0).select("doc_id", "ids", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    return w.select("doc_id", "k", F.slice("ids", F.col("k") * window + 1, F.lit(window)).alias("x"), F.slice("ids", F.col("k") * window + 2, F.lit(window)).alias("y"))


def read_target_sets(spark: SparkSession, path: str, strategies: list[str]) -> DataFrame:
    """Tests of several strategies together, the first of each name, with the name as ``strategy``."""
    return reduce(DataFrame.unionByName, [read_targets(spark, path, s).withColumn("strategy", F.lit(s)) for s in strategies])


def target_pairs(spark: SparkSession, path: str, strategy: str = "csr") -> DataFrame:
    """``category, prompt, target, full`` of a strategy's tests."""
    t = read_targets(spark, path, strategy)
    kind = F.when(F.col("category") == "unknown", "targets_json").otherwise(F.col("category"))
    return t.select(kind.alias("category"), F.col("input").alias("prompt"), F.col("target_completion").alias("target"), F.concat_ws(" ", "input", "target_completion").alias("full"))


def log_totals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``entries, malformed``: every line of a log, and those that are no entry."""
    rows = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return rows.agg(F.count("*").alias("entries"), F.count_if(F.col("e._bad").isNotNull()).alias("malformed"))


def write_vocabulary(pieces: DataFrame, path: str) -> None:
    """``piece`` and ``score`` of ``(id, piece, score)``, tab-separated, in the order of ids (a vocabulary is one small file)."""
    pieces.orderBy("id").select("piece", "score").coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def normal_events(events: DataFrame) -> DataFrame:
    """Events with timestamps of whole seconds, from ISO text with or without a fraction and a 'Z'."""
    raw = F.regexp_replace("timestamp", r"(\.\d*)?Z?$", "")
    return events.withColumn("timestamp", F.to_timestamp(F.replace(raw, F.lit("T"), F.lit(" "))))


def insert_events(events: DataFrame, path: str, batch: str) -> int:
    """Writes a batch of events and returns how many it has. A batch has a folder of its own, so that one
    that is sent or run again replaces itself; an empty one leaves nothing."""
    rows = normal_events(events)
    n = rows.count()
    if n:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return n


def inserted_events(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with columns that only later ones have."""
    return spark.read.option("mergeSchema", True).parquet(path)


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events that a receiver drops into a folder as JSON, one file a request."""
    return spark.readStream.schema(TELEMETRY).json(path)
