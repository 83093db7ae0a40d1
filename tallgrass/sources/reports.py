"""Reports and configuration: JSON and Markdown of small aggregates, blinded pairs with their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(summary: DataFrame, path: str, about: dict[str, str] | None = None) -> None:
    """One JSON object: what the report is about, and the rows of an aggregate."""
    rows = summary.agg(F.collect_list(F.struct(*summary.columns)).alias("rows"))  # an aggregate's rows: few
    rows.select(*[F.lit(v).alias(k) for k, v in (about or {}).items()], "rows").coalesce(1).write.mode("overwrite").json(path)


def markdown(title: str, summary: DataFrame, limit: int = 100) -> str:
    """A title and a table of an ordered aggregate's first ``limit`` rows."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    row = lambda values: "| " + " | ".join(map(cell, values)) + " |"
    return "\n".join([f"# {title}", "", row(summary.columns), "|" + "-|" * len(summary.columns), *map(row, summary.limit(limit).collect()), ""])


def blinded(pairs: DataFrame, seed: str) -> DataFrame:
    """``pairs(n, prompt, old, new)`` with sides swapped by a coin of the seed and the number."""
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("n").cast("string"))), 1, 7), 16, 10).cast("long") % 2 == 0
    side = lambda a, b: F.when(F.col("A_is_old"), F.col(a)).otherwise(F.col(b))
    return pairs.withColumn("A_is_old", coin).select("n", "prompt", side("old", "new").alias("completion_A"), side("new", "old").alias("completion_B"), "A_is_old")


def write_blinded(pairs: DataFrame, path: str, seed: str) -> None:
    """``blinded`` without, and ``key`` with, the side of each; both come from the same draws."""
    both = blinded(pairs, seed)
    both.drop("A_is_old").write.mode("overwrite").json(f"{path}/blinded")
    both.select("n", "A_is_old").write.mode("overwrite").json(f"{path}/key")


def configured(defaults: dict, *layers: dict) -> dict:
    """Defaults under each layer in turn; nested settings merge, and nulls leave what is there."""
    out = dict(defaults)
    for layer in layers:
        for name, value in layer.items():
            if isinstance(value, dict):
                out[name] = configured(out.get(name) or {}, value)
            elif value is not None:
                out[name] = value
    return out
