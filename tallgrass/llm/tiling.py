"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``seed`` consecutive words that a document shares with a benchmark
item: an index of the items' word shingles is joined to each document's rolling
(Karp-Rabin) hashes inside one streaming pass over the documents, so no document is
shuffled. Each pair with seeds is then tiled by running Karp-Rabin: the longest unmarked
common run is marked, again and again, until none of at least ``seed`` words is left. The share of
the item's words that tiles cover is its coverage, whatever order they stand in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import small_batches, staged, text_key

SEED_WORDS = 5
COVERAGE = 0.8
#: Text of benchmark items that is sent to executors at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TRIM = ".,;:!?\"'()[]{}*$%&#|<>«»¿¡-_"


def words(text: str | None) -> list[str]:
    """Lower-case words without surrounding punctuation; what is nothing else is no word."""
    return [w for w in (x.strip(_TRIM) for x in (text or "").lower().split()) if w]


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of each run of ``size`` ids."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k : len(ids) - size + 1 + k].astype(np.uint64)
    return out


class Index:
    """Word ids and seed positions of a block of items.

    A document that covers a share ``coverage`` of an item's n words by tiles of ``seed`` words or
    more shares at least ``ceil(coverage * n / seed)`` of its seeds (a tile of L words has L - seed + 1
    of them, a fifth of L at least where seeds have five words). So all but that many less one are
    listed, those of the most frequent words left out: a seed that many items have costs nothing
    unless the item's rarer ones are met too. An item of fewer words is one seed, the whole of it.
    """

    def __init__(self, items: list[tuple[int, str | None]], seed: int = SEED_WORDS, coverage: float = COVERAGE):
        self.seed, self.ids, self.items, self.whole = seed, {}, [], []
        for item, text in items:
            found = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.int64)
            if len(found):
                self.items.append((item, found))
        self.sizes = sorted({min(seed, len(x)) for _, x in self.items})
        hashes = [rolling(x, min(seed, len(x))) for _, x in self.items]
        often: dict[int, int] = {}
        for h in hashes:
            for x in set(h.tolist()):
                often[x] = often.get(x, 0) + 1
        at: dict[int, dict[int, list[int]]] = {n: {} for n in self.sizes}
        for k, ((_, found), h) in enumerate(zip(self.items, hashes, strict=True)):
            self.whole.append((np.sort(h), np.argsort(h, kind="stable")))
            need = max(1, math.ceil(coverage * len(found) / seed - 1e-9)) if len(found) >= seed else 1
            rare = sorted(range(len(h)), key=lambda i: (often[int(h[i])], i))[: max(1, len(h) - need + 1)]
            for x in {int(h[i]) for i in rare}:
                at[min(seed, len(found))].setdefault(x, []).append(k)
        self.at = at
        self.hashes = {n: np.array(sorted(x), np.uint64) for n, x in at.items()}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a document's words; 0 for any word that no item has."""
        raw = (text or "").lower().split()
        get, trim = self.ids.get, _TRIM
        # most words need no trimming: try as they are, then without punctuation
        found = [get(w) or get(w.strip(trim), 0 if w.strip(trim) else -1) for w in raw]
        ids = np.fromiter(found, np.int64, len(found))
        return ids[ids >= 0]

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item number -> (document position, item position) of shared seeds, for items of which a listed one is met."""
        out: dict[int, list[tuple[int, int]]] = {}
        known = np.r_[0, np.cumsum(ids > 0)]
        for size in self.sizes:
            if len(ids) < size:
                continue
            spots = np.flatnonzero(known[size:] - known[:-size] == size)  # runs of known words only
            h = np.zeros(len(spots), np.uint64)
            for k in range(size):
                h = h * _BASE + ids[spots + k].astype(np.uint64)
            listed = self.hashes[size]
            near = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
            met = {k for x in set(h[listed[near] == h].tolist()) for k in self.at[size][x]}
            if not met:
                continue
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            for k in sorted(met):
                item = self.items[k][1]
                own, places = self.whole[k]
                lo, hi = np.searchsorted(sorted_h, own, "left"), np.searchsorted(sorted_h, own, "right")
                pairs = [
                    (d, i)
                    for x, y, i in zip(lo.tolist(), hi.tolist(), places.tolist(), strict=True)
                    for d in spots[order[x:y]].tolist()
                    if (item[i : i + size] == ids[d : d + size]).all()
                ]
                if pairs:
                    out[k] = pairs
        return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=out[1:])
    return out


class KarpRabin:
    """Hashes of any run of a sequence, from sums of scaled ids: those of one length roll along it."""

    def __init__(self, ids: np.ndarray, powers: np.ndarray):
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * powers[: len(ids)], dtype=np.uint64)]
        self.powers = powers

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Of the runs at ``starts``, all scaled to one power."""
        return (self.sums[starts + length] - self.sums[starts]) * self.powers[len(self.powers) - 1 - starts]


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: ``(document start, item start, length)`` of marked
    matches, longest first, ties by item then document position; marks never overlap.

    Runs of a search length, which is halved from the item's length down to ``least``, are
    hashed in both; equal ones are compared, extended as far as nothing is marked, and the
    longest marked, until no unmarked match of that length is left. ``seeds`` are all
    equal runs of ``least`` words, so each match starts at one.
    """
    doc_used, item_used = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    powers = _powers(max(len(doc), len(item)))
    in_doc, in_item = KarpRabin(doc, powers), KarpRabin(item, powers)
    live = np.array(sorted(set(seeds), key=lambda x: (x[1], x[0])), np.int64).reshape(-1, 2)
    out: list[tuple[int, int, int]] = []
    length = max(least, 1 << max(0, len(item).bit_length() - 1))
    while len(live):
        while True:
            used_d, used_i = np.r_[0, np.cumsum(doc_used)], np.r_[0, np.cumsum(item_used)]
            fits = live[(live[:, 0] + length <= len(doc)) & (live[:, 1] + length <= len(item))]
            free = (used_d[fits[:, 0] + length] == used_d[fits[:, 0]]) & (used_i[fits[:, 1] + length] == used_i[fits[:, 1]])
            fits = fits[free]
            fits = fits[in_doc.of(fits[:, 0], length) == in_item.of(fits[:, 1], length)]
            found, ends = [], {}
            for d, i in fits.tolist():
                # a run inside a match that starts earlier on the same diagonal adds nothing
                if ends.get(d - i, -1) >= d + length or (doc[d : d + length] != item[i : i + length]).any():
                    continue
                n, most = length, min(len(doc) - d, len(item) - i)
                while n < most and doc[d + n] == item[i + n] and not doc_used[d + n] and not item_used[i + n]:
                    n += 1
                ends[d - i] = d + n
                found.append((-n, i, d))
            if not found:
                break
            best = min(found)[0]
            for n, i, d in sorted(found):
                if n != best:
                    break
                if not (doc_used[d : d - n].any() or item_used[i : i - n].any()):
                    doc_used[d : d - n] = item_used[i : i - n] = True
                    out.append((d, i, -n))
        if length == least:
            break
        length = max(least, length // 2)
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """Items of ``benchmark(item_id, text)`` in lists of at most about ``limit`` bytes each, fetched
    one by one as they are asked for. An item is a test question, so one always fits."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // limit))
    if count == 1:
        yield [(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()]
        return
    items = staged(items, "benchmark")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r[0], r[1]) for r in items.filter(part == k).orderBy("item_id", "text").collect()]


def _found(rows: DataFrame, block: list[tuple[int, str | None]], coverage: float, seed: int):
    """Matches of ``rows(text, doc_id, ...)`` with one block of items, and the broadcast that holds it."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES
    schema = rows.drop("text").schema
    for name, kind in (("item_id", "long"), ("coverage", "double"), ("n_tiles", "integer"), ("n_item_words", "integer"), ("longest", "integer")):
        schema = schema.add(name, kind)

    def run(batches):
        index = Index(sent.value, seed, coverage)
        for batch in batches:
            at, found = [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                ids = index.encode(text)
                for k, spots in index.seeds(ids).items():
                    item_id, item = index.items[k]
                    least = min(seed, len(item))
                    # too little in common to reach the threshold: seeds bound what tiles can cover
                    if len({i + j for _, i in spots for j in range(least)}) < coverage * len(item):
                        continue
                    marked = tiles(ids, item, spots, least)
                    share = sum(n for _, _, n in marked) / len(item)
                    if share >= coverage:
                        at.append(row)
                        found.append((item_id, share, len(marked), len(item), max(n for _, _, n in marked)))
            types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema), sent


def _matches(rows: DataFrame, benchmark: DataFrame, coverage: float, seed: int) -> DataFrame:
    small_batches(rows.sparkSession)
    rest = blocks(benchmark)
    block, after = next(rest), next(rest, None)
    found, sent = _found(rows, block, coverage, seed)
    if after is None:
        return found
    # One block at a time: what it finds is written and its broadcast goes before the next is fetched.
    parts = []
    while True:
        parts.append(staged(found, "matches"))
        sent.destroy()
        if after is None:
            return reduce(DataFrame.unionByName, parts)
        found, sent = _found(rows, after, coverage, seed)
        after = next(rest, None)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, n_item_words, longest`` of each document and
    item whose words are covered to at least ``coverage`` by tiles of at least ``seed`` words.

    An item under ``seed`` words matches where the whole of it stands in the text. Null and
    wordless texts and items match nothing; repeated rows and ids are each reported; a
    null doc_id is reported as null; empty tables give no rows. Other columns are ignored.
    """
    return _matches(docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")), benchmark, coverage, seed)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS) -> DataFrame:
    """``docs`` without the rows whose text covers a benchmark item; other rows and all columns as given.

    Each row is judged by its own text: a null id is no excuse, and a clean row that shares
    its id with a leaking one stays.
    """
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), text_key(F.col("text")).alias("th"))
    bad = staged(_matches(rows, benchmark, coverage, seed).select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct(), "leaks")
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    return inner.join(bad, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("t")), "left_anti").select("row.*")
