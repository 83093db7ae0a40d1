"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (which combines map-side, so a hub costs no single
task) and an equi-join. The minima are a table of their own, for Spark splits a hub's
rows only where the join meets no aggregate. Every round is
written to the shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import discard, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    near = _both(edges)
    least = staged(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", paths)
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least", paths)
    return (
        down.join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, root)``, root the least node reachable.

    Nodes without an edge to another node are not listed. Self loops, repeated and
    reversed edges are allowed; rows with a null end are dropped; no edges give no rows.
    """
    links = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    paths: list[str] = []  # tables of a round, of which the next needs the links alone
    links = staged(links.distinct(), "links", paths)
    seen = None
    for _ in range(rounds):
        old, paths = paths, []
        links = _small_star(_large_star(links, old), old).filter("a <> b").distinct()
        links = staged(links, "links", paths)
        discard(edges.sparkSession, old)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
