"""One token stream over a whole corpus: places by distributed prefix sums, windows and packed
windows that cross documents and partitions. No row, task or group holds the stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.shared import staged

BLOCK = 65_536  # examples that one state map of the packing covers
FAN = 64  # maps that one task composes


def placed(df: DataFrame, order: list[str], size: str | None = None) -> DataFrame:
    """``df``, staged, with ``number`` (its rank from 0 in the given order) and ``start`` (the sum of
    ``size`` over all rows before, of ones if none is named). Rows are sorted by ranges and
    summed up where they lie; the one ordered window holds a row a partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = [*df.columns, "_part", "number", "start"]

    def add(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, rows, whole = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64) if size else np.ones(batch.num_rows, np.int64)
            upto = np.cumsum(sizes)
            own = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(rows, rows + batch.num_rows)), pa.array(whole + upto - sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=names)
            rows, whole = rows + batch.num_rows, whole + int(sizes.sum())

    rows = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(add, f"{kinds}, _part int, number long, start long"), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.col("start") + (F.col(size) if size else F.lit(1)))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"), last.alias("s"))
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in ("n", "s")])
    parts = F.broadcast(parts)  # a row a shuffle partition
    return rows.join(parts, "_part").select(*df.columns, (F.col("number") + F.col("_n_before")).alias("number"), (F.col("start") + F.col("_s_before")).alias("start"))


def token_stream(examples: DataFrame, order: list[str], ids: str = "ids") -> DataFrame:
    """``number, start, n, ids`` of examples one after another in the given order; those without ids
    count none. A null array is empty."""
    x = examples.select(*order, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return placed(x.withColumn("n", F.size("ids").cast("long")), order, "n").select("number", "start", "n", "ids")


def tokens_of(stream: DataFrame) -> int:
    return stream.agg(F.max(F.col("start") + F.col("n"))).first()[0] or 0


def windows(stream: DataFrame, window: int) -> DataFrame:
    """``window_no, x, y``: all whole windows of the stream and the same shifted by one. A window of
    ``window + 1`` ids is gathered from the examples that it cuts; what is left at the end is dropped."""
    total = tokens_of(stream)
    s, e = F.col("start"), F.col("start") + F.col("n")
    first = F.floor(F.greatest(s - 1, F.lit(0)) / window)
    rows = stream.filter("n > 0").select("start", "n", "ids", F.explode(F.sequence(first, F.floor((e - 1) / window))).alias("window_no"))
    a = F.greatest(s, F.col("window_no") * window)
    b = F.least(e, F.col("window_no") * window + window + 1)
    part = F.slice("ids", (a - s + 1).cast("int"), (b - a).cast("int"))
    rows = rows.filter(F.col("window_no") < (total - 1) // window).select("window_no", F.struct(a.alias("at"), part.alias("ids")).alias("p"))
    whole = rows.groupBy("window_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("w"))
    return whole.select("window_no", F.slice("w", 1, window).alias("x"), F.slice("w", 2, window).alias("y"))


def _step(used: np.ndarray, n: int, room: int) -> np.ndarray:
    """Ids in the open window after an example of n, for each count before."""
    if n > room:
        return np.zeros_like(used)
    return np.where(used + n > room, n, used + n)


def _state_map(sizes: np.ndarray, room: int) -> np.ndarray:
    """The ids in the open window after a block, for every count at its begin. Counts soon meet,
    so that few are carried on."""
    states = np.arange(room + 1)
    back = np.arange(room + 1)
    for k, n in enumerate(sizes.tolist()):
        states = _step(states, n, room)
        if len(states) > 1 and (k < 8 or k % 64 == 0):
            states, which = np.unique(states, return_inverse=True)
            back = which[back]
    return states[back]


def _entries(maps: DataFrame, blocks: int, fan: int) -> DataFrame:
    """``block, used``: the ids in the open window where each block begins. Maps are composed by
    groups of ``fan``, their compositions likewise, and the counts go down the same tree."""
    g = maps.withColumn("g", F.floor(F.col("block") / fan))

    def walked(used: int, rows: pd.DataFrame) -> list[tuple[int, int]]:
        out = []
        for block, to in sorted(zip(rows["block"].tolist(), rows["map"], strict=True)):
            out.append((block, used))
            used = int(to[used])
        return out

    if blocks <= fan:
        return g.groupBy("g").applyInPandas(lambda rows: pd.DataFrame(walked(0, rows), columns=["block", "used"]), "block long, used int")

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, to in sorted(zip(rows["block"].tolist(), rows["map"], strict=True), key=lambda x: x[0]):
            whole = np.asarray(to) if whole is None else np.asarray(to)[whole]
        return pd.DataFrame({"block": [rows["g"].iloc[0]], "map": [whole.tolist()]})

    above = staged(g.groupBy("g").applyInPandas(composed, "block long, map array<int>"), "state-maps")
    begun = _entries(above, -(-blocks // fan), fan).select(F.col("block").alias("g"), F.col("used").alias("at"))
    return g.join(begun, "g").groupBy("g").applyInPandas(lambda rows: pd.DataFrame(walked(int(rows["at"].iloc[0]), rows), columns=["block", "used"]), "block long, used int")


def packed(stream: DataFrame, room: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``number, window_start, offset, kept`` of every example that has ids: greedy packing in order. An
    example that doesn't fit the open window opens the next; one of over ``room`` ids is cut
    to them and stands alone. ``window_start`` is the place of the window's first id in the stream.

    The ids in the open window are all that an example needs to know of those before, so a block
    of examples is a map of ``room + 1`` counts, maps compose, and blocks then run side by side.
    """
    if room < 1:
        raise ValueError("a window has room for an id")
    sized = stream.filter("n > 0").select("number", "start", F.col("n").alias("size"), F.floor(F.col("number") / block).alias("block"))
    last = sized.agg(F.max("block")).first()[0]

    def state_map(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values("number")["size"].to_numpy()
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "map": [_state_map(sizes, room).tolist()]})

    maps = staged(sized.groupBy("block").applyInPandas(state_map, "block long, map array<int>"), "state-maps")
    begun = staged(_entries(maps, (last or 0) + 1, fan), "block-states")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("number"), []
        used = int(rows["used"].iloc[0])
        opened = int(rows["start"].iloc[0]) - used
        for number, start, n in rows[["number", "start", "size"]].itertuples(index=False):
            if n > room or used == 0 or used + n > room:
                opened, used = start, 0
            out.append((number, opened, used, min(n, room)))
            used = 0 if n > room else used + n
        return pd.DataFrame(out, columns=["number", "window_start", "offset", "kept"])

    return sized.join(begun, "block").groupBy("block").applyInPandas(walk, "number long, window_start long, offset int, kept int")


def packed_windows(stream: DataFrame, room: int, pad: int = 0, **how) -> DataFrame:
    """``window_start, examples, length, truncated, x, y``: the packed windows, filled up with ``pad``; ``x``
    and ``y`` are inputs and targets, shifted by one. A window holds ``room`` ids at most."""
    rows = stream.join(packed(stream, room, **how), "number").select("window_start", "kept", (F.col("n") > F.col("kept")).alias("cut"), F.struct("offset", F.slice("ids", F.lit(1), F.col("kept")).alias("ids")).alias("p"))
    w = rows.groupBy("window_start").agg(
        F.count("*").alias("examples"), F.sum("kept").alias("length"), F.bool_or("cut").alias("truncated"),
        F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"),
    )
    full = F.concat("ids", F.array_repeat(F.lit(pad), room - F.size("ids")))
    return w.select("window_start", "examples", "length", "truncated", F.slice(full, 1, room - 1).alias("x"), F.slice(full, 2, room - 1).alias("y"))
