"""Removal of repeated byte passages by difference-cover suffix sorting.

A byte goes if some ``length``-byte string that covers it starts anywhere else too.

1. Texts are told apart by digest, and one row stands for equal ones. In each, every window of ``length``
   bytes has an anchor: its first least-hashed ``anchor``-byte string. Equal windows have
   equal anchors at equal offsets, so windows of an anchor that occurs once are unique.
2. The stretches of text under anchors that recur are cut out, one for each anchor's place.
   A stretch that a task meets again, byte for byte, is not sent again: all of its windows
   are repeated.
3. Anchors with at most ``MANY`` places have little to compare: their stretches meet in a task, where
   identical ones are folded and the different ones suffix sorted by the difference cover.
4. The stretches of all other anchors are sorted across the cluster by the difference cover
   modulo 3 (``distributed_repeats``): sampled strings are sorted and named, triples of
   names are sorted and named again until they span a third of a window, and the
   remaining suffixes are merged with the sampled ones by the bytes that lead to the next
   sampled place. Names come from distinct strings that stand twice or more (a window that
   holds another is not repeated), and equal windows are counted by their keys, so that a
   passage of a billion copies costs no task more than another.
5. Repeated windows return to their texts as runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import discard, partitions, small_batches, staged, task_number

LENGTH = 400
ANCHOR = 128
#: The stretches of an anchor with more places than this are sorted across the cluster.
MANY = 4096
#: Bytes of the strings that are named first there.
FIRST = 46
#: Bytes of stretches that are suffix sorted at a time.
SORT_BYTES = 1_000_000
#: Stretches that a task remembers, to send one that it meets again only once.
REMEMBERED = 100_000


def windows_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed polynomial hashes of each ``size``-byte string, by doubling."""
    width, h = 1, data.astype(np.uint64) + np.uint64(1)
    whole: np.ndarray | None = None
    done, left, base = 0, size, 0x100000001B3
    power = np.uint64(base)
    while left:
        if left & 1:
            n = len(data) - done - width + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            whole = h[done : done + n].copy() if whole is None else whole[:n] * power + h[done : done + n]
            done += width
        left >>= 1
        if left:
            h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
            power, width = np.uint64(int(power) ** 2 % (1 << 64)), width * 2
    out = whole
    out ^= out >> np.uint64(32)
    out = out * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width``, from minima of blocks, forward and back."""
    n = len(x) - width + 1
    lanes = -(-len(x) // width) * width
    padded = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last window start that it has."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none
    h = windows_hash(np.frombuffer(data, np.uint8), anchor)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    tagged = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # ties: the first place
    least = sliding_least(tagged, length - anchor + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:] - 1, len(place) - 1]
    return h[place[first]], place[first], first, last


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of non-negative integers, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.uint64)
    t[:n] = s.astype(np.uint64) + np.uint64(1)
    sigma = np.uint64(int(t.max()) + 1)
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a dummy suffix at n where the last full triple needs one
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if int(sigma) < 1 << 21:
        key = (t[sample] * sigma + t[sample + 1]) * sigma + t[sample + 2]
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        o = sample[order]
        fresh = np.r_[True, (t[o[1:]] != t[o[:-1]]) | (t[o[1:] + 1] != t[o[:-1] + 1]) | (t[o[1:] + 2] != t[o[:-1] + 2])]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(fresh) - 1
    sa12 = sample[order] if fresh.all() else sample[suffix_array(name)]
    rank = np.zeros(n + 4, np.uint64)
    rank[sa12] = np.arange(1, len(sa12) + 1, dtype=np.uint64)
    base = np.uint64(n + 5)
    zero = np.arange(0, n, 3)
    key0 = t[zero] * base + rank[zero + 1]
    zero, key0 = (lambda o: (zero[o], key0[o]))(np.argsort(key0, kind="stable"))
    sa12 = sa12[sa12 < n]
    ones, twos = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    # merge: a suffix at 0 mod 3 meets one at 1 by (s, rank) and one at 2 by (s, s, rank)
    below = np.searchsorted(t[ones] * base + rank[ones + 1], key0)
    if int(sigma) ** 2 * int(base) < 1 << 63:
        below += np.searchsorted((t[twos] * sigma + t[twos + 1]) * base + rank[twos + 2], (t[zero] * sigma + t[zero + 1]) * base + rank[zero + 2])
    else:
        both = np.concatenate([twos, zero])
        _, pair = np.unique(t[both] * sigma + t[both + 1], return_inverse=True)
        key = pair.astype(np.uint64) * base + rank[both + 2]
        below += np.searchsorted(key[: len(twos)], key[len(twos) :])
    out = np.empty(n, np.int64)
    spots = below + np.arange(len(zero))
    out[spots] = zero
    rest = np.ones(n, bool)
    rest[spots] = False
    out[rest] = sa12
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts have a ``length``-byte string that another start has too."""
    valid = np.zeros(len(data), bool)
    valid[starts] = True
    order = suffix_array(data)
    order = order[valid[order]]
    words = np.zeros(len(data) + 8, np.uint64)
    words[: len(data)] = data
    for k, width in enumerate((1, 2, 4)):
        words[:-width] |= words[width:] << np.uint64(8 << k)
    alive = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k in steps:
        alive = alive[words[order[alive] + k] == words[order[alive + 1] + k]]
    hit = np.zeros(len(data), bool)
    hit[order[alive]] = hit[order[alive + 1]] = True
    return hit[starts]


def _runs(first: int, flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield first + a, first + b - 1


def _fold(rows: Iterator[tuple[int, bytes, int, int, bytes]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Runs ``(text key, first, last)`` of repeated window starts, from rows ``(group key,
    text key, first window start, number of window starts, stretch)`` ordered by group.
    Of a group, only its different stretches are held, each with the one place that it
    has been seen at."""
    held: list[tuple[bytes, tuple[bytes, int] | None, int]] = []
    size = 0

    def sort() -> Iterator[tuple[bytes, int, int]]:
        data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        offset = np.r_[0, np.cumsum([len(x[0]) for x in held])[:-1]]
        starts = np.concatenate([o + np.arange(x[2]) for o, x in zip(offset, held, strict=True)])
        hits = np.split(repeated_starts(data, starts, length), np.cumsum([x[2] for x in held])[:-1])
        for (_, place, _), flags in zip(held, hits, strict=True):
            if place is not None:
                for a, b in _runs(place[1], flags):
                    yield place[0], a, b

    def close() -> Iterator[tuple[bytes, int, int]]:
        nonlocal held, size
        if len(distinct) > 1:
            held += [(stretch, place, len(stretch) - length + 1) for stretch, place in distinct.items()]
            size += sum(map(len, distinct))
        if size > SORT_BYTES:
            yield from sort()
            held, size = [], 0

    distinct: dict[bytes, tuple[bytes, int] | None] = {}  # None: met more than once
    g_now = None
    for g, key, first, n, stretch in rows:
        if g != g_now:
            yield from close()
            g_now, distinct = g, {}
        if stretch in distinct:
            yield key, first, first + n - 1
            if (place := distinct[stretch]) is not None:
                yield place[0], place[1], place[1] + n - 1
                distinct[stretch] = None
        else:
            distinct[stretch] = (key, first)
    yield from close()
    if held:
        yield from sort()


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: it grows with the corpus, and a staged table of
    10 MB holds a hundred in the driver's hash table."""
    return df.hint("merge")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _named(rows: DataFrame, key: list[str], paths: list[str]) -> DataFrame:
    """``pid, names``: the rows ``(pid, i, *key)`` with each key replaced by its number in the order
    of all keys that stand twice or more, gathered by piece as ``array<struct<i, name>>`` (a few hundred
    each). Rows whose key stands once have no name: no string that contains it is repeated."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def number(batches):
        part, at = task_number(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*key, "part", "at"])
            at += n

    several = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    ordered = several.repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    table = staged(ordered.mapInArrow(number, f"{kinds}, part int, at long"), "names", paths)
    sizes = table.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    names = table.join(F.broadcast(before), "part").select(*key, (F.col("before") + F.col("at")).alias("name"))
    joined = rows.join(unsent(names), key).groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("i", "name"))).alias("names"))
    return staged(joined, "named", paths)


def shifts(length: int, lead: int, width: int) -> tuple[int, int, int] | None:
    """Where names of ``width`` bytes have to start, in multiples of 3, to span a window but for the
    ``lead`` bytes before them and at most two after: the second and third place and the bytes left."""
    third = (length - lead - width) // 3 * 3
    second = max(0, -(-(third - width) // 3) * 3)
    return (second, third, length - lead - width - third) if third >= 0 and second <= width else None


def distributed_repeats(pieces: DataFrame, length: int, paths: list[str], first: int = FIRST) -> DataFrame:
    """``pid, i``: the places in the distinct strings ``pieces(pid, data)`` whose ``length`` bytes
    stand at another place of a piece too.

    The difference cover {1, 2} modulo 3: strings at sampled places are sorted and named, then
    triples of names at places a multiple of 3 apart, until names span a third of a window. Two
    windows both begin 0, 1 or 2 bytes before sampled places, whatever their places are. So each
    is keyed by those bytes, the names from there on, and the one or two bytes that names leave
    over; keys of one kind are in the order of their windows, and equal just if these are.
    """
    small_batches(pieces.sparkSession)
    width = max(3, min(first, length // 3))

    def grams(batches):
        for batch in batches:
            places, data = _bytes(batch.column(1))
            n = np.diff(places)
            owner = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(data)) - places[owner]
            spots = np.flatnonzero((i % 3 > 0) & (i + width <= n[owner]))
            strings = np.lib.stride_tricks.sliding_window_view(data, width)[spots] if len(spots) else np.zeros((0, width), np.uint8)
            cells = pa.Array.from_buffers(pa.binary(), len(spots), [None, pa.py_buffer((np.arange(len(spots) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(strings))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[spots])), pa.array(i[spots].astype(np.int32)), cells], names=["pid", "i", "gram"])

    named = _named(pieces.mapInArrow(grams, "pid long, i int, gram binary"), ["gram"], paths)
    while any(shifts(length, lead, width) is None for lead in (0, 1, 2)):
        step = width // 3 * 3

        def triples(batches, step=step):
            for batch in batches:
                owner, i, name, spot = _places(batch.column(1))
                x, y = spot(owner, i + step), spot(owner, i + 2 * step)
                ok = np.flatnonzero((x >= 0) & (y >= 0))
                cols = [owner[ok], i[ok], name[ok], name[x[ok]], name[y[ok]]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=["pid", "i", "x", "y", "z"])

        named = _named(named.mapInArrow(triples, "pid long, i int, x long, y long, z long"), ["x", "y", "z"], paths)
        width += 2 * step

    def keys(batches):
        for batch in batches:
            owner, i, name, spot = _places(batch.column(1))
            places, data = _bytes(batch.column(2))
            n = np.diff(places)
            starts = np.maximum(0, n - length + 1)
            who = np.repeat(np.arange(len(n)), starts)
            at = np.arange(len(who)) - np.repeat(np.cumsum(starts) - starts, starts)
            for lead in (0, 1, 2):
                second, third, left = shifts(length, lead, width)
                mine = np.flatnonzero((at % 3 > 0) if lead == 0 else (at % 3 == 0) | (at % 3 == lead))
                spots = [spot(who[mine], at[mine] + lead + d) for d in (0, second, third)]
                ok = (spots[0] >= 0) & (spots[1] >= 0) & (spots[2] >= 0)  # else some string in the window stands once
                w, a = who[mine][ok], at[mine][ok]
                raw = np.full(len(w), lead, np.int64)
                for k in [*range(lead), *range(length - left, length)]:
                    raw = raw * 256 + data[places[w] + a + k]
                names = [name[x[ok]] for x in spots]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w)), pa.array(a.astype(np.int32)), pa.array(raw), *map(pa.array, names)], names=["pid", "i", "q", "x", "y", "z"])

    keyed = named.join(unsent(pieces.select("pid", "data")), "pid").select("pid", "names", "data").mapInArrow(keys, "pid long, i int, q long, x long, y long, z long")
    keyed = staged(keyed, "window-keys", paths)
    key = ["q", "x", "y", "z"]
    several = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    return keyed.join(unsent(several), key, "left_semi").select("pid", "i").distinct()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return places - places[0], data[places[0] : places[-1]]


def _places(column: pa.Array):
    """Owners, places and names of ``array<struct<i, name>>`` rows in order, and a finder of (owner, place)."""
    offsets, values = _flat(column)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    i, name = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    keys = owner << 32 | i

    def spot(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        wanted = w << 32 | at
        near = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return np.where(keys[near] == wanted, near, -1) if len(keys) else np.full(len(wanted), -1)

    return owner, i, name, spot


def _stretches(rows: DataFrame, again: DataFrame, twice: bool, kept: list[str], length: int, anchor: int) -> DataFrame:
    """``g, key, s, n, many, stretch`` of each place of a recurring anchor: the group, the text's key, the first
    window start and their number, whether the anchor has many places, and the bytes, null where a
    task has met them twice, so that the windows are known to be repeated. Written."""
    paths: list[str] = []

    def mark(batches):
        for batch in batches:
            found = [anchors(data, length, anchor) for data in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x[1]) for x in found]).astype("i8"))
            cols = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(4)]
            cols = [cols[0].view(np.int64), *(c.astype("i4") for c in cols[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, cols)], names=["doc_id", "key", "h", "p", "s", "e"])

    one = again.withColumn("several", F.lit(True))
    stands = F.expr("several IS NULL OR doc_id <=> rep")
    marked = rows.select("doc_id", "key", "data").mapInArrow(mark, "doc_id long, key binary, h long, p int, s int, e int")
    marked = staged(marked, "anchors", paths).join(unsent(one), "key", "left").filter(stands).select("key", "h", "p", "s", "e")
    if twice:
        marked = marked.dropDuplicates(["key", "p"])
    marked = staged(marked, "places", paths)
    discard(rows.sparkSession, [paths.pop(0)])
    # Tables of their own, so that the joins meet no aggregate and Spark can split the places of a hot anchor and the copies of a text.
    often = staged(marked.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "recurring-anchors", paths)
    place = F.struct("p", "h", "s", "e", (F.col("n") > MANY).alias("many"))
    spans = marked.join(unsent(often), "h").groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("spans"))
    spans = staged(spans.join(unsent(one), "key", "left"), "spans", paths)

    def cut(batches):
        met: dict[bytes, tuple | None] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0
            for key, data, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for x in spans:
                    stretch = data[x["s"] : x["e"] + length]
                    row = (x["h"], key, x["s"], x["e"] - x["s"] + 1, x["many"])
                    if stretch in met:
                        first, met[stretch] = met[stretch], None
                        for known in (row, first) if first else (row,):
                            for col, v in zip(out, (*known, None), strict=True):
                                col.append(v)
                    else:
                        if len(met) == REMEMBERED:
                            met.clear()
                        met[stretch] = row
                        for col, v in zip(out, (*row, stretch), strict=True):
                            col.append(v)
                        size += len(stretch)
                if size > 4_000_000:
                    yield _stretch_batch(out)
                    out, size = ([], [], [], [], [], []), 0
            yield _stretch_batch(out)

    joined = rows.filter(F.octet_length("data") >= length).join(unsent(spans), "key").filter(stands).select("key", "data", "spans")
    if twice:
        joined = joined.dropDuplicates(["key"])
    found = staged(joined.mapInArrow(cut, "g long, key binary, s int, n int, many boolean, stretch binary"), "stretches", kept)
    discard(rows.sparkSession, paths, shuffles=True)
    return found


def _stretch_batch(out) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["g", "key", "s", "n", "many", "stretch"])


def _sorted_in_tasks(stretches: DataFrame, length: int) -> DataFrame:
    """``key, a, b``: runs of repeated window starts of stretches whose groups are small."""

    def sort(batches):
        dealt = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list = []
        for row in _fold(dealt, length):
            out.append(row)
            if len(out) == 20_000:
                yield _run_batch(out)
                out = []
        yield _run_batch(out)

    small_batches(stretches.sparkSession)
    dealt = stretches.select("g", "key", "s", "n", "stretch").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(sort, "key binary, a int, b int")


def _sorted_across(stretches: DataFrame, length: int, paths: list[str]) -> DataFrame:
    """The same of stretches whose groups may hold any number of places."""
    own = F.struct("key", "s", "n")
    pieces = stretches.groupBy("stretch").agg(F.min(own).alias("own"), F.count("*").alias("places"))
    pieces = staged(pieces.select(F.monotonically_increasing_id().alias("pid"), F.col("stretch").alias("data"), "own", "places"), "pieces", paths)
    whole = stretches.join(unsent(pieces.filter("places > 1").select(F.col("data").alias("stretch"))), "stretch", "left_semi").selectExpr("key", "s AS a", "s + n - 1 AS b")
    hits = distributed_repeats(pieces.select("pid", "data"), length, paths)
    step = F.col("i") - F.row_number().over(Window.partitionBy("pid").orderBy("i"))
    runs = hits.withColumn("island", step).groupBy("pid", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    runs = runs.join(unsent(pieces.filter("places = 1").select("pid", "own")), "pid").selectExpr("own.key", "own.s + a AS a", "own.s + b AS b")
    return whole.unionByName(runs)


def repeated_runs(rows: DataFrame, again: DataFrame, twice: bool, paths: list[str], length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``key, runs`` for ``rows(doc_id, key, data)``: the runs of window starts whose string
    starts elsewhere too, in this or another text, of each distinct text (by its ``key``).

    Of the texts of ``again(key, rep)``, which several rows hold, the row of id ``rep``
    stands for all; ``twice`` says that several rows may have both the text and that id.
    """
    stretches = _stretches(rows, again, twice, paths, length, anchor)
    known = stretches.filter("stretch IS NULL").selectExpr("key", "s AS a", "s + n - 1 AS b")
    runs = known.unionByName(_sorted_in_tasks(stretches.filter("stretch IS NOT NULL AND NOT many"), length))
    hot = stretches.filter("stretch IS NOT NULL AND many")
    if hot.limit(1).count():
        runs = runs.unionByName(_sorted_across(hot, length, paths))
    return runs.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def _run_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["key", "a", "b"])


def removed(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges (end exclusive) from runs of repeated window starts."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs(doc_id, text)``,
    and with ``with_text`` the remaining bytes as ``kept``.

    Null text is empty. Texts of at least ``length`` bytes that two rows share lose all
    their bytes, whatever their ids; null and repeated ids are rows like any other; an
    empty table gives none. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long"), data.alias("data")).withColumn("key", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))
    paths: list[str] = []
    slim = staged(rows.filter(F.octet_length("data") >= length).select("doc_id", "key"), "text-digests", paths)
    again = staged(slim.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("key", "rep"), "copied-texts", paths)
    same = slim.join(unsent(again), "key").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("key").count().filter("count > 1")
    runs = repeated_runs(rows, again, bool(same.limit(1).count()), paths, length, anchor)
    fate = staged(runs.join(again.select("key", F.lit(True).alias("whole")), "key", "full").select("key", "runs", "whole"), "repeated-runs")
    discard(docs.sparkSession, paths, shuffles=True)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def strip(batches):
        for batch in batches:
            out = []
            for doc_id, data, runs, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = [(0, len(data))] if whole else removed([(r["a"], r["b"]) for r in runs or ()], length)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left)[: len(names)])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(names)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(unsent(fate), "key", "left").select("doc_id", "data", "runs", "whole").mapInArrow(strip, schema)
