"""Periodic runs of words: stretches that repeat one block of words several times over.

Every lag is compared, up to the words divided by the least exponent. Words become ids, and
the texts of a batch stand in one id array (no id is shared between texts, so nothing
matches across them); a lag is one vectorised comparison of the array with itself. As a run
of exponent e matches at e - 1 multiples of its lag in a row, a lag is first compared at its
multiples alone, and word by word only in texts where that many match in a row. The true
stretches of that comparison are the runs.

The lags of a long text are dealt out as several ranges over the cluster, and the ranges'
runs meet again by text: a run that one range sees at a multiple of its period has the same
ends there, so the smallest period of equal ends is the run's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACES, added, let, partitions, small_batches, staged

RUNS = "array<struct<start:long,length:long,period:long>>"
BLOCK_WORDS = 1_000_000  # of texts that are scanned together
RANGE_BYTES = 65_536  # of text for each range of lags
MOST_RANGES = 64


def _divisors(q: int) -> list[int]:
    small = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return small + [q // d for d in small if d * d != q]


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true stretches of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


class _Known:
    """Runs found so far by period, to tell the places that need no second look."""

    def __init__(self) -> None:
        self.lists: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, period: int, start: int, end: int) -> None:
        self.lists[period].append((start, end))
        self.arrays.pop(period, None)

    def covered(self, places: np.ndarray, q: int) -> np.ndarray:
        """Places x with x and x + q in one run whose period divides q: the stretch of lag q around x is that run."""
        out = np.zeros(len(places), bool)
        for d in _divisors(q):
            if d in self.lists:
                if d not in self.arrays:
                    self.arrays[d] = tuple(np.array(sorted(self.lists[d])).T)
                starts, ends = self.arrays[d]
                near = np.searchsorted(starts, places, "right") - 1
                out |= (near >= 0) & (ends[near] > places + q)
        return out


def scan(ids: np.ndarray, ends: np.ndarray, exponent: int, least: int, first: int = 1, step: int = 1) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each text in ``ids``, sorted.

    ``ends`` are the texts' ends in ``ids``; ids of different texts differ. The lags are
    ``first``, ``first + step`` and so on; with a step over 1 a period may be a multiple
    of the smallest.
    """
    starts = ends - np.diff(np.r_[0, ends])
    found: list[dict[tuple[int, int], int]] = [{} for _ in ends]
    known = _Known()
    longest = int((ends - starts).max(initial=0))
    for q in range(first, longest // exponent + 1, step):
        grid = ids[::q]
        hit = grid[1:] == grid[:-1]
        row = hit[: len(hit) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            row &= hit[k : k + len(row)]
        places = np.flatnonzero(row) * q
        if len(places):
            places = places[~known.covered(places, q)]
        while len(places):
            doc = int(np.searchsorted(ends, places[0], "right"))
            a, b = int(starts[doc]), int(ends[doc])
            same = ids[a + q : b] == ids[a : b - q]
            for s, e in zip(*(x.tolist() for x in _stretches(same, max(least - q, (exponent - 1) * q)))):
                if (s, e + q) not in found[doc]:
                    part = ids[a + s : a + e + q]
                    period = q if step == 1 else min(d for d in _divisors(q) if (part[d:] == part[:-d]).all())
                    found[doc][s, e + q] = period
                    known.add(period, a + s, a + e + q)
            places = places[places >= b]
    return [sorted((s, e - s, p) for (s, e), p in runs.items()) for runs in found]


def _ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the texts in one array, and where each ends. No two texts share an id."""
    parts, base = [], 0
    for words in texts:
        index = {w: base + i for i, w in enumerate(dict.fromkeys(words))}
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        base += len(index)
    return np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([len(p) for p in parts]).astype(np.int64)


def _blocks(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """The texts' words, in blocks of a bounded number of words (or one text)."""
    block, size = [], 0
    for text in texts:
        words = (text or "").encode().split()  # bytes split at just the contract's white space
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    if block:
        yield block


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _run_rows(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)


def _with_results(batch: pa.RecordBatch, found: list[list[tuple[int, int, int]]], kept: list[bytes], names: list[str]) -> pa.RecordBatch:
    columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n in names[:-2]]
    return pa.RecordBatch.from_arrays([*columns, _run_rows(found), pa.array(kept, pa.string())], names=names)


def with_runs(docs: DataFrame, exponent: int = 4, least: int = 6, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``_runs`` (start, length and period of every run, by start and period) and
    ``_collapsed`` (the words that no run drops, joined by a space).

    A run is a stretch of words with smallest period q, of at least ``exponent * q`` and
    ``least`` words, that no neighbouring word extends. Null and empty texts have no runs
    and an empty ``_collapsed``; repeated rows and ids each keep their own; a column of an
    added name moves it on by an underscore. Texts of over ``range_bytes`` bytes have their
    lags dealt out as ranges, at most 64 of them; results are the same.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    spark = docs.sparkSession
    small_batches(spark)
    runs_name, kept_name, uid, part = added(docs.columns, "_runs", "_collapsed", "_uid", "_range")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = [*docs.columns, runs_name, kept_name]
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) / F.lit(range_bytes))).cast("int")

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found, kept = [], []
            for block in _blocks(batch.column("text").to_pylist()):
                runs = scan(*_ids(block), exponent, least)
                found += runs
                kept += [collapsed(w, r) for w, r in zip(block, runs, strict=True)]
            yield _with_results(batch, found, kept, names)

    def lags(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text, key, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = next(_blocks([text]))
                (runs,) = scan(*_ids([words[0]]), exponent, least, k + 1, n)
                flat = np.array(runs, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), key)), *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3))], names=["uid", "start", "length", "period"])

    def summed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [[(r["start"], r["length"], r["period"]) for r in runs or []] for runs in batch.column(runs_name).to_pylist()]
            kept = [collapsed((t or "").encode().split(), r) for t, r in zip(batch.column("text").to_pylist(), found, strict=True)]
            yield _with_results(batch, found, kept, names)

    schema = f"{fields}{', ' if fields else ''}`{runs_name}` {RUNS}, `{kept_name}` string"
    short = docs.filter(ranges <= 1).mapInArrow(whole, schema)
    # A text's own number is staged with it, so that every later read sees the same.
    long = staged(docs.filter(ranges > 1).withColumn(uid, F.monotonically_increasing_id()), "long-texts")
    dealt = long.select(F.col("text").cast("string"), F.col(uid).alias("uid"), F.explode(F.sequence(F.lit(0), ranges - 1)).alias("k"), ranges.alias("n"))
    seen = dealt.repartition(partitions(spark), "uid", "k").mapInArrow(lags, "uid long, start long, length long, period long")
    runs = seen.groupBy("uid", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias(runs_name)).withColumnRenamed("uid", uid)
    return short.unionByName(long.join(runs.hint("merge"), uid, "left").drop(uid).mapInArrow(summed, schema))


def planted(doc_id: Column, text: Column) -> Column:
    """A text with a known repetition from some word on, for one id in ten: with the unsigned crc32 h
    of the decimal id, n words, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), word
    i >= a becomes word a + (i - a) % p. Other texts, those without a word, and null ids stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)

        def body(at: Column) -> Column:
            a, p = at["a"].cast("int"), at["p"].cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), body)).otherwise(text)

    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return F.when((h % 10 == 0) & text.isNotNull(), let(words, changed)).otherwise(text)


def runs_digest(runs: Column) -> Column:
    """SHA-256 of a line ``start,length,period`` for every run."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(line, "").cast("binary"), 256)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equals the first, then that of smallest period. Null if there is none."""
    better = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(better)
