"""Evaluation-set construction beyond the sentence filters: cuts, categories, exclusions, pairs by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text

REFERENCE = r"\[[A-Za-z0-9]+\]"
PAREN = r"\([^)]*\)"


def strip_references(x: Column) -> Column:
    return F.regexp_replace(x, REFERENCE, "")


def strip_parentheses(x: Column) -> Column:
    return text.strip(F.regexp_replace(x, PAREN, ""))


def has_shouted_word(s: Column, least: int = 4) -> Column:
    """A word of some length in capitals."""
    return F.exists(text.words(s), lambda w: (F.length(w) >= least) & (w == F.upper(w)) & (w != F.lower(w)))


def late_cut(s: DataFrame, back: int = 12, ahead: int = 4, seed: str = "7") -> DataFrame:
    """``sentence`` cut mid to late: the target has ``ahead`` to ``back`` words, the prompt two at least.
    The place is drawn by a hash of the sentence; sentences with no choice are left out."""
    x = s.withColumn("_w", text.words(F.col("sentence"))).withColumn("_n", F.size("_w")).filter("_n >= 8")
    x = x.withColumn("_lo", F.greatest(F.lit(2), F.col("_n") - back)).withColumn("_hi", F.col("_n") - ahead).filter("_hi > _lo")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("sentence"))), 1, 7), 16, 10).cast("long")
    x = x.withColumn("_cut", (F.col("_lo") + draw % (F.col("_hi") - F.col("_lo") + 1)).cast("int"))
    x = x.withColumn("prompt", F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ")).withColumn("target", F.array_join(F.slice("_w", F.col("_cut") + 1, F.col("_n")), " "))
    return x.withColumn("target_words", F.col("_n") - F.col("_cut")).drop("_w", "_n", "_lo", "_hi", "_cut")


def category(words: Column) -> Column:
    return F.when(words <= 6, "short").when(words <= 9, "medium").otherwise("long")


def zipped(left: DataFrame, right: DataFrame, key: list[str], order: str, name: tuple[str, str]) -> DataFrame:
    """Rows of two tables paired by their position in each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)).alias("pos")
    a, b = left.select(*key, place, F.col("text").alias(name[0])), right.select(*key, place, F.col("text").alias(name[1]))
    return a.join(b, [*key, "pos"])


def kept_paragraphs(x: Column, least: int = 40) -> Column:
    """Paragraphs that are no script and have ``least`` characters."""
    script = lambda p: p.contains("document.write") | p.contains("function(") | p.startswith("var ") | p.contains("$.ajax")
    return F.filter(F.transform(x, text.strip), lambda p: ~script(p) & (F.length(p) >= least))


def by_source_priority(df: DataFrame, key: Column, source: str, order: list[str], priority: Sequence[str] = ()) -> DataFrame:
    """Of rows with one key the one whose source stands first in ``priority`` (sources that it doesn't name come
    after those that it does, by name); a grouped minimum, so that no group is gathered."""
    named = F.array_position(F.array(*map(F.lit, priority)).cast("array<string>"), F.col(source))
    place = F.when(F.coalesce(named, F.lit(0)) > 0, named).otherwise(len(priority) + 1).alias("_place")
    first = F.min(F.struct(place, F.col(source), *[F.col(c) for c in order])).alias("first")
    return df.groupBy(key.alias("key")).agg(first, F.count("*").alias("n")).select("first.*", "n").drop("_place")
