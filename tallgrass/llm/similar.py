"""Near duplicates by the Jaccard similarity of word shingles, for the pipeline.

Texts are sets of hashed five-word shingles; two are near duplicates at a similarity
of 0.8 or more. Candidates come from SimHash by bit-sliced comparison, as in ``simhash``, at a
radius that is wide enough for that similarity; an exact check follows.

1. A set's fingerprint has ``BITS`` bits, each the majority over its shingles, and further bits of the
   same kind make the keys of the candidate tables, ``r`` bits each. A bit of two sets at 0.8 differs
   with a chance of ``DIFFER`` at most, so there are as many tables as let such a pair pass all of
   them with a chance of 3 in 10 million; closer pairs have less. Keys are longer where there are
   more rows. Sets of four and five shingles (0.8 exactly, and bits that differ more often) share the
   key of four shingles instead.
2. In a bucket the fingerprints are stored as ``BITS`` vertical bit planes, and carry-save counters tell
   the lanes that differ in at most ``RADIUS`` bits, leaving words of lanes that are all over by then
   after ``FIRST`` (a pair at 0.8 is beyond either bound with a chance of some 1e-8). Lanes so linked
   are a part. Equal parts of several tables are one. What no bit can tell, counts can: two sets share no
   more than either shares with all others, so that sets with over a fifth of their shingles to
   themselves get no lane, and lanes whose counts rule the similarity out are not linked.
3. Only verified links are ever closed over. First each set is compared whole with the least one of
   its parts, a pair a set however many tables found it, which settles most near copies. Where a part's sets are then not of
   one component, all its sets of different components are compared: sizes and counts by bins
   bound what two sets can share, and sets that pass are compared whole. A part of over
   ``BLOCK`` members is dealt into blocks, and each pair of blocks is a group of its own, so
   that a task holds two blocks at most. Links are thinned to a forest where they are found.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import discard, small_batches, staged
from tallgrass.llm.components import connected_components
from tallgrass.llm.simhash import ROW, SEED, kept_rows, named, representatives, with_row_key

SHINGLE = 5
#: Similarity of near duplicates, as a fraction of whole numbers.
NUM, DEN = 4, 5
BINS = 1024
#: Rows to a bucket of shingles that are counted together.
COUNTED = 2048
#: Members of a part that one task compares with each other, or with as many more.
BLOCK = 4096
#: Bits of a fingerprint, and of those how many may differ.
BITS, RADIUS = 192, 62
#: Words of lanes of which none has at most so many differing bits among so many first ones are left.
FIRST, FIRST_RADIUS = 128, 47
#: The chance that a bit differs at a similarity of 0.8, at most (sets of 15 shingles; large ones: 0.1515), and that a pair is missed.
DIFFER, MISSED = 0.1612, 3e-7
#: Bits of a table's key, at least; rows in a bucket beyond which keys are longer.
LEAST_KEY, BUCKET = 12, 512
#: Buckets up to this size are compared lane against shifted lane, longer ones query by query.
SHORT_RUN = 128
#: Lanes whose buckets are compared together.
LANES = 65_536
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return np.zeros(0, "<u8")
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], "<u8"))


def set_key(found: np.ndarray) -> int:
    """A digest of the set, as a signed long; the empty set has zero."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], "<u8").view("<i8")[0]) if len(found) else 0


def key_bits(rows: int) -> int:
    """Bits of a table's key over so many rows."""
    return max(LEAST_KEY, ceil(log2(max(1, rows) / BUCKET)))


def tables_of(bits: int) -> int:
    """Tables with keys of so many bits that miss a pair at 0.8 with a chance of ``MISSED``."""
    return ceil(log(MISSED) / log(1 - (1 - DIFFER) ** bits))


def fingerprint(found: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """The ``BITS`` bits of a set, as words, and its keys in all tables (none of the empty set)."""
    if not len(found):
        return np.zeros(BITS // 64, "<u8"), []
    n = tables_of(bits)
    steps = np.arange(1, BITS // 64 + -(-n * bits // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * len(steps), np.int64)
    for k in range(0, len(found), 255):
        z = found[k : k + 255, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))).astype("<u8", copy=False)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    set_bits = 2 * ones > len(found)
    keys = set_bits[BITS : BITS + n * bits].reshape(n, bits) @ (1 << np.arange(bits)) + (np.arange(n) << bits)
    few = [found] if len(found) == 4 else [np.delete(found, i) for i in range(5)] if len(found) == 5 else []
    return np.packbits(set_bits[:BITS], bitorder="little").view("<u8"), keys.tolist() + [-1 - (abs(set_key(x)) >> 1) for x in few]


def planes_of(prints: np.ndarray) -> np.ndarray:
    """``BITS`` rows of packed bits: row p holds bit p of each lane of ``prints(lane, word)``, in whole 64-bit words."""
    padded = np.zeros((-(-len(prints) // 64) * 64, BITS // 64), "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differ: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes in which at most ``radius`` of the planes ``differ`` are set, as packed words. Planes of a weight
    wait for a second one; both and the weight's sum go through a full adder, whose carry goes on."""
    sums: list[np.ndarray] = []
    held: list[np.ndarray | None] = []
    for x in differ:
        level = 0
        while True:
            if level == len(sums):
                sums.append(np.zeros_like(x))
                held.append(None)
            if (y := held[level]) is None:
                held[level] = x
                break
            either = x ^ y
            x = (x & y) | (either & sums[level])
            sums[level] = either ^ sums[level]
            held[level] = None
            level += 1
    for level, x in enumerate(held):
        if x is not None:
            for k in range(level, len(sums)):
                sums[k], x = sums[k] ^ x, sums[k] & x
            sums.append(x)
    over, equal = np.zeros_like(differ[0]), np.full_like(differ[0], _ALL)
    for k in range(max(len(sums), radius.bit_length()) - 1, -1, -1):
        bit = sums[k] if k < len(sums) else np.zeros_like(over)
        if radius >> k & 1:
            equal &= bit
        else:
            over |= equal & bit
            equal &= ~bit
    return ~over


def _joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least lane that each of ``n`` lanes reaches over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        if (least == label[left]).all() and (least == label[right]).all():
            return label
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]


def _differ(planes: np.ndarray, words: np.ndarray, shift: int) -> np.ndarray:
    """The words of lanes against those ``shift`` lanes on: set where the two differ."""
    at, by = words + (shift >> 6), np.uint64(shift & 63)
    other = planes[:, at]
    if by:
        other = other >> by
        other |= planes[:, at + 1] << (np.uint64(64) - by)
    other ^= planes[:, words]
    return other


def possible(n: np.ndarray, shared: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles, of which ``shared`` and ``other`` stand in any other set, may be similar."""
    both = np.minimum(shared, other)
    return DEN * both >= NUM * (n + m - both)


def _short_parts(prints: np.ndarray, run: np.ndarray, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The least lane of each lane's part, for buckets ``run`` (equal, adjacent ids) of at most ``SHORT_RUN``."""
    planes = np.pad(planes_of(prints), ((0, 0), (0, SHORT_RUN // 64 + 2)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shift in range(1, min(SHORT_RUN, len(run))):
        same = run[shift:] == run[:-shift]
        if not same.any():
            break
        words = np.flatnonzero(same) >> 6
        words = words[np.r_[True, words[1:] != words[:-1]]]
        words = words[within(_differ(planes[:FIRST], words, shift), FIRST_RADIUS) != 0]
        if not len(words):
            continue
        near = np.unpackbits(within(_differ(planes, words, shift)).astype("<u8").view(np.uint8), bitorder="little")
        hit = (words[:, None] * 64 + np.arange(64)).ravel()[near.astype(bool)]
        hit = hit[hit < len(same)]
        hit = hit[same[hit]]
        hit = hit[possible(n[hit], shared[hit], n[hit + shift], shared[hit + shift])]
        left.append(hit)
        right.append(hit + shift)
    return _joined(len(run), np.concatenate(left), np.concatenate(right))


def _long_parts(prints: np.ndarray, size: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The same for one larger bucket. Lanes near a common one are found first, and are no queries then."""
    n, planes, label = len(prints), planes_of(prints), np.arange(len(prints))

    def near(lanes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(prints[lanes].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        asked = (np.uint64(0) - bits.T.astype(np.uint64))[:, :, None]
        found = np.ascontiguousarray(within(asked ^ planes[:, None, :]))
        close = np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
        for row, lane in zip(close, lanes, strict=True):
            row &= possible(size, shared, size[lane], shared[lane])
            row[lane] = True
        return close

    some = np.unique(np.linspace(0, n - 1, 16).astype(np.int64))
    around = near(some)
    main = around[around.sum(axis=1).argmax()]
    label[main] = np.flatnonzero(main)[0]
    rest, queries = np.flatnonzero(~main), max(1, 4096 // planes.shape[1])
    for k in range(0, len(rest), queries):
        for row in near(rest[k : k + queries]):
            parts = np.unique(label[row])
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    return label


def parts_of(keys: np.ndarray, prints: np.ndarray, n: np.ndarray | None = None, shared: np.ndarray | None = None) -> np.ndarray:
    """The least lane of each lane's part, of whole buckets (equal, adjacent ``keys``). ``n`` and ``shared`` tell how many
    shingles a set has, and how many of them stand in others; without them bits alone decide."""
    label = np.arange(len(keys))
    n, shared = (np.zeros(len(keys), np.int64) if x is None else x for x in (n, shared))
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    lanes = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes))
    if len(lanes):
        label[lanes] = lanes[_short_parts(prints[lanes], keys[lanes], n[lanes], shared[lanes])]
    for a, size in zip(edges[:-1][sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        label[a : a + size] = a + _long_parts(*(x[a : a + size] for x in (prints, n, shared)))
    return label


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity, exactly."""
    low, high = sorted((len(a), len(b)))
    if DEN * low < NUM * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (low + high - both)


def _bins(own: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of ``BINS``: two sets share no more than the sum of the lesser counts."""
    return np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.uint32)


def forest(sets: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of similar ``(key, label, side, set)`` that join components. Sets of a label are of one already;
    of two sides, sets of one side are not compared with each other. A set is held against all
    before it at once by sizes and by bins, which rule out most; what they leave is compared whole."""
    label = np.array([x[1] for x in sets], np.int64)
    if len(sets) < 2 or (label == label[0]).all():
        return []
    side = np.array([x[2] for x in sets])
    both = len(set(side.tolist())) > 1
    size = np.array([len(x[3]) for x in sets], np.int64)
    bins = np.stack([_bins(x[3]) for x in sets])
    links = []
    for i in range(1, len(sets)):
        near = label[:i] != label[i]
        if both:
            near &= side[:i] != side[i]
        near &= (DEN * np.minimum(size[:i], size[i]) >= NUM * np.maximum(size[:i], size[i]))
        at = np.flatnonzero(near)
        for k in range(0, len(at), 512):
            part = at[k : k + 512]
            shared = np.minimum(bins[part], bins[i]).sum(axis=1).astype(np.int64)
            for j in part[DEN * shared >= NUM * (size[part] + size[i] - shared)].tolist():
                if label[j] != label[i] and similar(sets[j][3], sets[i][3]):
                    links.append((sets[j][0], sets[i][0]))
                    label[label == label[i]] = label[j]
    return links


def marked_sets(rows: DataFrame, bits: int) -> DataFrame:
    """``doc_id, th, fp, n, prints, keys`` of each row of ``rows(doc_id, text, th)``; ``n`` is how many shingles it has."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            fps, n = pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            made = [fingerprint(s, bits) for s in sets]
            prints, keys = pa.array([x.view("<i8") for x, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, n, prints, keys], names=["doc_id", "th", "fp", "n", "prints", "keys"])

    return rows.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th binary, fp long, n long, prints array<long>, keys array<long>")


def shared_shingles(rows: DataFrame, buckets: int) -> DataFrame:
    """``fp, shared``: how many shingles of each set of ``rows(doc_id, text, th)`` stand in a different set too, where
    any does. Shingles are dealt by hash into ``buckets`` (65,536 at most), a word of 48 bits of hash and 16 of
    its text's place among the batch's, and counted there; hashes that agree in these bits count as shared."""
    small_batches(rows.sparkSession)
    place = np.uint64(0xFFFF)

    def deal(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            fps = np.array([set_key(s) for s in sets], "<i8")
            found, owner = np.concatenate([np.zeros(0, "<u8"), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            bucket = ((found & place) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, owner, bucket = found[order], owner[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
            out: tuple[list, list] = ([], [])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = owner[a:b]
                fresh = np.r_[True, own[1:] != own[:-1]]  # in order, as the sort keeps it
                out[0].append(fps[own[fresh]].tobytes())
                out[1].append(((found[a:b] & ~place) | (np.cumsum(fresh) - 1).astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "fps", "words"])

    def counted(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        fps = [np.frombuffer(x, "<i8") for x, _ in held]
        words = [np.frombuffer(x, "<u8") for _, x in held]
        start = np.cumsum([0, *map(len, fps)])[:-1]
        owner = np.concatenate([(w & place).astype(np.int64) + at for w, at in zip(words, start, strict=True)])
        every = np.concatenate(fps)
        first = np.zeros(len(every), bool)  # of equal sets one counts
        first[np.unique(every, return_index=True)[1]] = True
        stays = first[owner]
        found, owner = np.concatenate(words)[stays] >> np.uint64(16), owner[stays]
        order = np.argsort(found)
        found, owner = found[order], owner[order]
        same = np.r_[False, found[1:] == found[:-1], False]
        n = np.bincount(owner[same[1:] | same[:-1]], minlength=len(every))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(every[some], pa.int64()), pa.array(n[some], pa.int64())], names=["fp", "shared"])

    def count(batches):
        last, held = None, []
        for batch in batches:
            for bucket, fps, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and held:
                    yield counted(held)
                    held = []
                last = bucket
                held.append((fps, words))
        if held:
            yield counted(held)

    dealt = rows.select("text").mapInArrow(deal, "bucket long, fps binary, words binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "fp long, shared long").groupBy("fp").agg(F.sum("shared").alias("shared"))


def _pairs(links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_parts(sets: DataFrame) -> DataFrame:
    """``k, fp, least, c`` of the distinct sets ``sets(fp, prints, keys)``: each set in the parts that it shares with
    another, with the least of the part and how many it holds. ``k`` is a digest of the members, so that a
    part that several tables find is one. ``sets`` may also have ``n`` and ``shared``, as ``parts_of`` takes them."""
    words = [f"p{i}" for i in range(BITS // 64)]
    of = lambda i: F.when(F.col("k") < 0, F.lit(0).cast("long")).otherwise(F.col("prints")[i])  # noqa: E731  # four equal shingles: no distance counts
    counts = [F.col(c) if c in sets.columns else F.lit(0).cast("long").alias(c) for c in ("n", "shared")]
    rows = sets.select(F.explode("keys").alias("k"), "fp", "prints", *counts).select("k", "fp", "n", "shared", *[of(i).alias(w) for i, w in enumerate(words)])

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        k, fp, prints = cols[0], cols[1], np.stack(cols[4:], axis=1).view(np.uint64)
        label = parts_of(k, prints, cols[2], cols[3])
        c = np.bincount(label, minlength=len(label))[label]
        lanes = np.flatnonzero(c > 1)
        lanes = lanes[np.argsort(label[lanes], kind="stable")]
        starts = np.flatnonzero(np.r_[True, label[lanes][1:] != label[lanes][:-1]]) if len(lanes) else lanes
        n = np.diff(np.r_[starts, len(lanes)])
        part = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in np.split(fp[lanes], starts[1:])] if len(lanes) else [], np.uint64).view(np.int64)
        cols = [np.repeat(part, n), fp[lanes], np.repeat(fp[lanes[starts]], n), c[lanes]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["k", "fp", "least", "c"])

    def run(batches):
        """Whole buckets are compared together; what a batch ends in is held until its bucket ends."""
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            size += batch.num_rows
            if size >= LANES:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield found([x[:cut] for x in cols])
                held, size = [[x[cut:] for x in cols]], len(cols[0]) - cut
        if size:
            yield found([np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = rows.repartition("k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(run, "k long, fp long, least long, c long").dropDuplicates(["k", "fp"])


def whole_sets(rows: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp, hashes`` of ``wanted(fp)``, read again from the least row of each."""
    least = firsts.join(wanted.hint("merge"), "fp", "left_semi")
    least = least.select(F.col("first.doc_id").alias("i"), F.col("first.th").alias("t")).hint("merge")  # at every size, as in kept_rows
    few = rows.join(least, rows["doc_id"].eqNullSafe(least["i"]) & (rows["th"] == least["t"]), "left_semi")

    def read(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "hashes"])

    return few.mapInArrow(read, "fp long, hashes binary").dropDuplicates(["fp"])


def star_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of sets ``members(fp, least)`` that are similar to the ``least`` that they are given."""
    pairs = members.filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    of = lambda name: sets.select(F.col("fp").alias(name), F.col("hashes").alias(f"of_{name}")).hint("merge")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "of_a", "of_b"))
            yield _pairs([(p, q) for p, q, s, t in zip(a, b, x, y, strict=True) if similar(np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8"))])

    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def block_links(open_: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between different labels in the parts of ``open_(k, fp, label, c)``, by pairs of blocks of
    some ``block`` members each."""
    n = F.ceil(F.col("c") / block).cast("int")
    rows = open_.select("k", "fp", "label", F.pmod(F.xxhash64("fp", "k"), n).cast("int").alias("own"), n.alias("n"))
    rows = rows.select("k", "fp", "label", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    rows = rows.select("k", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), (F.col("own") > F.col("o")).cast("int").alias("side"), "fp", "label")

    def run(batches):
        last, held = None, []
        for batch in batches:
            links = []
            for k, lo, hi, side, fp, label, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, lo, hi) != last:
                    links += forest(held)
                    last, held = (k, lo, hi), []
                held.append((fp, label, side, np.frombuffer(hashes, "<u8")))
            yield _pairs(links)
        yield _pairs(forest(held))

    joined = rows.join(sets.hint("merge"), "fp").select("k", "lo", "hi", "side", "fp", "label", "hashes")
    return joined.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "fp").mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``doc_id, th, fp``, the least row ``first`` of each ``fp``, and the roots of those that link."""
    spark, paths, rows = docs.sparkSession, [], with_row_key(docs)
    count = docs.count()
    found = staged(marked_sets(rows, key_bits(count)), "shingle-prints", paths)
    shared = staged(shared_shingles(rows, min(65_536, count // COUNTED + 1)), "shared-shingles", paths)
    marked = staged(found.select("doc_id", "th", "fp"), "shingle-sets")
    firsts = staged(marked.groupBy("fp").agg(F.min(F.expr(ROW)).alias("first")), "distinct-sets")
    may = found.join(shared.hint("merge"), "fp").filter(F.col("shared") * DEN >= F.col("n") * NUM)  # else no other set is similar
    prints = staged(may.select("fp", "n", "shared", "prints", "keys").dropDuplicates(["fp"]), "distinct-prints", paths)
    small_batches(spark, 20_000)  # rows of seven numbers
    members = staged(near_parts(prints), "near-parts", paths)
    small_batches(spark)
    sets = staged(whole_sets(rows, firsts, members.select("fp").distinct()), "candidate-sets", paths)
    stars = staged(star_links(members.groupBy("fp").agg(F.min("least").alias("least")), sets), "star-links", paths)
    near = staged(connected_components(stars), "star-roots", paths)
    labelled = members.join(near.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("k", "fp", "c", F.coalesce("root", "fp").alias("label"))
    labelled = staged(labelled, "labels", paths)
    mixed = labelled.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    links = staged(block_links(labelled.join(mixed.select("k").hint("merge"), "k", "left_semi"), sets, block), "block-links", paths)
    roots = connected_components(stars.unionByName(links))
    discard(spark, paths)
    return marked, firsts, roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: ``fp`` is a digest of its shingles, ``component_id``
    the smallest doc_id among the rows linked to this one, directly or through others.

    Null and wordless texts are one component. Repeated rows and ids each keep a row;
    a component without ids has component_id null. An empty table gives no rows.
    """
    marked, firsts, roots = components(docs)
    return named(marked, firsts.select("fp", F.col("first.doc_id").alias("first")), roots)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays, and of
    rows with that id the one with the least text key. Rows without an id come last; rows that are
    equal in id and text count as one. Columns as given."""
    return kept_rows(docs, representatives(*components(docs)))
