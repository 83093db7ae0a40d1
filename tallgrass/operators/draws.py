"""Draws that repeat a seeded generator to the last digit: shuffles, splits and resampled intervals.

A seeded shuffle or resample depends on nothing but the number of rows. A shuffle is made of
row numbers in one task and joined to the rows by number; a resample is drawn again for each block of rows.
The scalable forms, whose draws are hashes of keys, stand beside each of these.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.stream import placed
from tallgrass.sources.shared import staged

MOST = 5_000_000  # row numbers that one task draws; an evaluation set has some thousands
BLOCK = 524_288  # values that one task resamples


def _counted(n: int, most: int) -> None:
    if n > most:
        raise ValueError(f"{n} rows are over the {most} that one seeded generator serves; use the hashed draws")


def shuffled(df: DataFrame, order: list[str], seed: int, most: int = MOST) -> DataFrame:
    """``df`` with ``place``: where Python's shuffle by ``seed`` puts each row of the given order.
    Rows that are equal in it may change places with each other; an empty table stays empty."""
    rows = placed(df, order)
    n = rows.count()
    _counted(n, most)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            turn = list(range(n))
            random.Random(seed).shuffle(turn)
            for a in range(0, n, 100_000):
                yield pd.DataFrame({"number": turn[a : a + 100_000], "place": range(a, min(n, a + 100_000))})

    turns = df.sparkSession.range(1).coalesce(1).mapInPandas(draw, "number long, place long")
    return rows.join(turns, "number").select(*df.columns, "place")


def first_shuffled(df: DataFrame, order: list[str], seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle; ``n`` is the feature."""
    return shuffled(df, order, seed).filter(F.col("place") < n)


def bootstrap_interval(df: DataFrame, value: str, order: list[str], n: int = 1000, confidence: float = 0.95, seed: int = 42, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row ``mean, lo, hi, n``: NumPy's seeded resamples with replacement of the values in the given
    order, their means, and the means' percentiles. Null values don't count; without values all are zero.

    Draws depend on the count of rows alone. So values lie in blocks of ``block`` consecutive row
    numbers; each block repeats the draws, adds up its own values that a resample takes, and leaves
    a sum a resample. A drawn row number is never a row, and no task holds more values than a block.
    """
    rows = placed(df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*order, value])), order).select("number", F.col(value).cast("double").alias("v"))
    whole = rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).first()
    total = whole["n"]
    _counted(total, most)
    if not total:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0)], "mean double, lo double, hi double, n long")

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["number"].min())
        values = np.empty(len(part))
        values[part["number"].to_numpy() - first] = part["v"].to_numpy()
        drawn, out = np.random.RandomState(seed), np.zeros(n)
        for b in range(n):
            taken = drawn.choice(total, size=total, replace=True) - first
            out[b] = values[taken[(taken >= 0) & (taken < len(values))]].sum()
        return pd.DataFrame({"b": range(n), "s": out})

    blocks = rows.groupBy(F.floor(F.col("number") / block)).applyInPandas(sums, "b int, s double")
    means = staged(blocks, "resampled").groupBy("b").agg((F.sum("s") / total).alias("m"))
    tail = (1 - confidence) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return ends.select(F.lit(whole["mean"]).alias("mean"), "lo", "hi", F.lit(total).cast("long").alias("n"))


def split_points(pieces: Column, seed: Column, bias: float = 0.2, least: int = 3) -> Column:
    """``p1, p2`` of a prefix, middle and suffix as Python's generator with a seed a row draws them: for a
    share of ``bias`` both are places where a word begins (ten tries for ``least`` pieces between
    them, then any places), else any places. Null for rows of under ``least + 2`` pieces."""

    @F.pandas_udf("p1 int, p2 int")
    def drawn(rows: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for row, s in zip(rows, seeds, strict=True):
            n = 0 if row is None else len(row)
            if n < least + 2 or s is None or s != s:
                out.append((None, None))
                continue
            r = random.Random(int(s))
            found = None
            if r.random() < bias:
                starts = sorted({0, n, *(i for i, p in enumerate(row) if p.startswith("▁"))})
                for _ in range(10 if len(starts) >= 3 else 0):
                    a = r.randint(0, len(starts) - 2)
                    b = r.randint(a + 1, len(starts) - 1)
                    if starts[b] - starts[a] >= least:
                        found = starts[a], starts[b]
                        break
            if found is None:
                a = r.randint(0, n - least)
                found = a, r.randint(a + least, n)
            out.append(found)
        return pd.DataFrame(out, columns=["p1", "p2"]).astype("Int32")

    return drawn(pieces, seed)
