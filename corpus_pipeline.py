"""A training-data pipeline in five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import mixing, repair, rules, similar, tiling
from tallgrass.llm.common import discard, new_path, table
from tallgrass.llm.queries import tokenizer_path

ORACLE_SQL: str | None = None  # learned rules, tiling and tokenisation are beyond SQL; tests compare with brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned rejecting rule go."""
    return rules.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a 5-word Jaccard similarity of 0.8 or more stays."""
    return similar.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover a benchmark item go."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as the fitted rates say; none is thinned out."""
    return mixing.taken(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id shards are written; a row a document tells where its ids are."""
    return repair.encoded(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_target_weights", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last. A stage's table goes once the next is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        old, path = path, new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old is not None:
            discard(spark, [old])
    return docs
