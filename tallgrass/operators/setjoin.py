"""Near copies of a stated set of queries in a corpus, by containment of their word shingles.

A query of n shingles is contained to a share t if a document has at least ceil(t * n) of
them, so it has one of the query's n - ceil(t * n) + 1 rarest: candidates meet by these
alone, rarest by the corpus's own counts, and are then counted exactly. The corpus's
shingles are first reduced to those that any query has, so that what is shuffled is
bounded by the matches, not by the corpus; a shingle that many documents share is a
candidate's key only where a query has no rarer ones. No pair that qualifies is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.sources.shared import staged

SHINGLE = 5


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run, a wordless or null one has none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(size)), " ")))
        return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<long>"))

    return text.let(words, of)


def contained(queries: DataFrame, corpus: DataFrame, num: int = 4, den: int = 5, size: int = SHINGLE) -> DataFrame:
    """``id, query, shared, n``: texts of ``corpus(id, text)`` that hold at least ``num / den`` of the shingles
    of a text of ``queries(query, text)``, in lower case, with how many they share of its ``n``.

    Null and blank texts match nothing; rows that repeat an id count as one text of all their
    shingles; an empty side gives no rows.
    """
    words = lambda c: text.words(F.lower(F.coalesce(c, F.lit(""))))
    asked = queries.select("query", F.explode(shingles(words(F.col("text")), size)).alias("s")).distinct()
    asked = staged(asked, "query-shingles")
    held = corpus.select("id", F.explode(shingles(words(F.col("text")), size)).alias("s"))
    held = staged(held.join(asked.select("s").distinct(), "s", "left_semi").distinct(), "shared-shingles")
    counts = held.groupBy("s").agg(F.count("*").alias("c"))
    w = Window.partitionBy("query")
    ranked = asked.join(counts, "s", "left").withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.coalesce("c", F.lit(0)), "s")))
    sized = staged(ranked.select("query", "s", "k", "n", F.ceil(F.col("n") * num / den).alias("least")), "query-prefixes")
    met = held.join(sized.filter("k <= n - least + 1").select("s", "query"), "s").select("id", "query").distinct()
    exact = met.join(sized.select("query", "s", "n", "least"), "query").join(held, ["id", "s"])
    return exact.groupBy("id", "query").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("least").alias("least")).filter("shared >= least").select("id", "query", "shared", "n")
