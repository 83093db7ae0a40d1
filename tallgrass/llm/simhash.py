"""SimHash near-duplicate detection by bit-sliced comparison.

A fingerprint is the bitwise majority over XXH64 hashes of word shingles. Two
fingerprints within ``radius`` bits agree wholly on some ``blocks - radius`` of
``blocks`` bit blocks, so the candidate tables are exact at any size; wider keys
are taken as the number of distinct fingerprints grows, so that buckets stay small.
Inside a bucket the fingerprints are stored as 64 vertical bit planes. Distances of
all lanes are updated together by carry-save counters (ones, twos, and a sticky
"over"), and a block of lanes is abandoned as soon as all of them are over.

A bucket of more than ``DENSE`` fingerprints is not compared in its task: its members
go on to ``dense_links``, where each is grouped with all fingerprints that are one bit
from a common one. A group holds 65 at most, whatever the bucket held, and any two in
it are within two bits, so that no task is longer for a dense bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import small_batches, staged, text_key
from tallgrass.llm.components import connected_components

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Runs up to this length are compared lane against shifted lane, longer ones query by query.
SHORT_RUN = 32
#: Buckets above this size are left to ``dense_links``.
DENSE = 2048


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text (null and wordless texts: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        starts = ends - length
        h = xxhash.xxh64_intdigest
        hashes = [h(flat[i:j], SEED) for i, j in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, counted in bounded slices."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, *also: str) -> DataFrame:
    """``(doc_id, fp)`` of each row, ``fp`` as a signed long, and the columns ``also``, as they are."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), *also)
    names = ["doc_id", *also, "fp"]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=names)

    return rows.mapInArrow(run, rows.drop("text").schema.add("fp", "long"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row p holds bit p of each lane, in whole 64-bit words."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, block: int = 64) -> np.ndarray:
    """Lanes whose planes differ in at most two bits, as packed words.

    ``left`` and ``right`` have 64 planes in their first axis and broadcast against
    each other in the rest. Words are taken in blocks, and a block is left at the
    first check at which each of its lanes has gone over the radius.
    """
    shape = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    out = np.zeros(shape, np.uint64)
    for k in range(0, shape[-1], block):
        cut = lambda x: x[..., k : k + block] if x.shape[-1] > 1 or shape[-1] == 1 else x  # noqa: E731, B023
        a, b = cut(left), cut(right)
        ones = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]), np.uint64)
        twos, over = ones.copy(), ones.copy()
        for p in range(64):
            x = a[p] ^ b[p]
            carry = ones & x
            ones = ones ^ x
            over |= twos & carry
            twos = twos ^ carry
            over |= ones & twos
            if p % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
        out[..., k : k + block] = ~over
    return out


def lanes_of(words: np.ndarray) -> np.ndarray:
    """Packed words as booleans, lane by lane, in the last axis."""
    flat = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(flat, axis=-1, bitorder="little").astype(bool)


def links_in_runs(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius inside each run (equal, adjacent ids) that connect it as
    all such pairs would; the pairs of a long run are thinned to a spanning forest."""
    if not len(fps):
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    short = np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes)
    left, right = [fps[:0]], [fps[:0]]
    f, r = fps[short], run[short]
    if len(f):
        planes = planes_of(f)
        for shift in range(1, SHORT_RUN):
            same = r[shift:] == r[:-shift]
            if not same.any():
                break
            near = lanes_of(within(planes_of(f[shift:]), planes[:, : -(-(len(f) - shift) // 64)]))
            hit = np.flatnonzero(near[: len(same)] & same)
            left.append(f[hit])
            right.append(f[hit + shift])
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
        a, b = _long_run(fps[s : s + n])
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _long_run(fps: np.ndarray, queries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A link to one lane of each part that a query joins: lanes carry the label of their part."""
    label = np.arange(len(fps))
    planes, left, right = planes_of(fps)[:, None, :], [], []
    for k in range(0, len(fps), queries):
        bits = np.unpackbits(fps[k : k + queries].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        asked = (np.uint64(0) - bits.T.astype(np.uint64))[:, :, None]
        near = lanes_of(within(asked, planes))[:, : len(fps)]
        for i, row in enumerate(near, k):
            lanes = np.flatnonzero(row[:i])
            parts, first = np.unique(label[lanes], return_index=True)
            if len(parts):
                left += [fps[i]] * len(parts)
                right += fps[lanes[first]].tolist()
                label[i] = parts[0]
                if len(parts) > 1:
                    label[:i][np.isin(label[:i], parts[1:])] = parts[0]
    return np.array(left, np.uint64), np.array(right, np.uint64)


def block_keys(distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the candidate tables: any pair within the radius agrees on one of them."""
    for blocks in range(radius + 1, 9):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]
        if distinct <= 4 << min(m.bit_count() for m in masks):
            break
    return masks


def dense_links(fps: DataFrame) -> DataFrame:
    """Links of distinct fingerprints ``fps(fp)`` that leave the same components as all pairs within two bits.

    Two fingerprints are that near just if some string is at most one bit from both. So each
    is listed under itself and its 64 neighbours, and all under one string link to the least.
    """
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b).cast("long")) for b in bits])
    listed = staged(fps.select("fp", F.explode(near).alias("c")), "neighbours")
    least = listed.groupBy("c").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("c", "m")
    return listed.join(least, "c").filter("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def near_links(fps: DataFrame, distinct: int, dense: int | None = None) -> DataFrame:
    """``fps(fp)`` of distinct fingerprints -> links ``(a, b)`` within the radius that
    leave the same components as all such links."""
    keys = [m - (1 << 64) if m >> 63 else m for m in block_keys(distinct)]
    dense = DENSE if dense is None else dense
    none = np.zeros(0, np.uint64)

    def run(batches):
        """Whole buckets of a batch are compared together; what a batch ends in is held, as a list
        of pieces, until its bucket ends or has grown too large to be compared here."""
        parts: list[np.ndarray] = []
        size, key, large = 0, None, False
        for batch in batches:
            t, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(f):
                continue
            f = f.view(np.uint64)
            cuts = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, len(f)]
            if key != (t[0], k[0]):
                yield linked(parts, large)
                parts, size, large = [], 0, False
            elif len(cuts) > 2:
                yield linked([*parts, f[: cuts[1]]], large or size + cuts[1] > dense)
                parts, size, large = [], 0, False
                f, cuts = f[cuts[1] :], cuts[1:] - cuts[1]
            n = np.diff(cuts)
            inner = np.repeat(n[:-1], n[:-1])
            whole, rest = f[: cuts[-2]], f[cuts[-2] :]
            yield rows(*links_in_runs(whole[inner <= dense], np.repeat(np.arange(len(n) - 1), n[:-1])[inner <= dense]), whole[inner > dense])
            parts.append(rest)
            size, key = size + len(rest), (t[-1], k[-1])
            if size > dense:
                large = True
                yield rows(none, none, np.concatenate(parts))
                parts = []
        yield linked(parts, large)

    def linked(parts, large):
        f = np.concatenate([none, *parts])
        return rows(none, none, f) if large else rows(*links_in_runs(f, np.zeros(len(f), np.int64)), none)

    def rows(a, b, alone):
        """Links, and as links to themselves the members of buckets that are too large."""
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, alone]).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

    masked = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(keys)])
    keyed = fps.select("fp", F.explode(masked).alias("x")).select("x.t", "x.k", "fp")
    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    found = staged(dealt.mapInArrow(run, "a long, b long"), "near-links")
    return found.filter("a <> b").unionByName(dense_links(found.filter("a = b").select(F.col("a").alias("fp")).distinct())).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, fp`` (signed long), ``fingerprint`` (16 hex digits) and
    ``component_id``: the smallest doc_id among the rows linked to this one, directly
    or through others. Null or wordless text has fingerprint zero, which links like
    any other; repeated rows and repeated ids each keep a row; a null doc_id is never
    the smallest, and a component of nothing else has component_id null. An empty
    table gives no rows. Other columns are ignored.
    """
    marked = staged(fingerprints(docs, size), "fingerprints")
    firsts = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    roots = connected_components(near_links(firsts.select("fp"), firsts.count()))
    return named(marked, firsts, roots).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def in_components(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """``firsts(fp, ...)`` with the ``root`` of the component of each, itself where it has no links."""
    return firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def named(marked: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of ``marked(doc_id, fp)``, given the smallest id of each ``fp``
    and the ``root`` of each ``node`` that has links. A hot fingerprint's rows are on the
    streamed side of the last join, which Spark splits."""
    parts = in_components(firsts, roots)
    least = parts.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = parts.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


#: What tells rows apart: the id, nulls last, then the text.
ROW = "struct(doc_id IS NULL AS nameless, doc_id, th)"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text, th``: the columns that decide, and the text's key."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("th"))


def kept_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep(doc_id, th, n)`` names, columns as given: each is a row by its id (null
    equals null) and text, and ``n`` says how many rows are equal in both, of which one stays."""
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))

    def of(some):
        # Merged at every size: the ids grow with the input, so the plan is not to change where they outgrow a broadcast.
        return inner.join(some.hint("merge"), F.col("id").eqNullSafe(some["doc_id"]) & (F.col("key") == some["th"]), "left_semi")

    kept = of(keep.filter("n = 1")).select("row.*")
    if keep.filter("n > 1").limit(1).count():
        kept = kept.unionByName(of(keep.filter("n > 1")).dropDuplicates(["id", "key"]).select("row.*"))
    return kept


def representatives(marked: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, th, n``: the least row of each component, given the least row ``first`` of each ``fp``
    and the rows ``marked(doc_id, th, fp)``."""
    least = in_components(firsts, roots).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.th")
    several = marked.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").withColumnsRenamed({"doc_id": "i", "th": "t"})
    both = least.join(several, least["doc_id"].eqNullSafe(several["i"]) & (least["th"] == several["t"]), "left")
    return staged(both.select("doc_id", "th", F.coalesce("n", F.lit(1)).alias("n")), "kept-rows")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id
    stays, and of rows with that id the one with the least text key; rows without an id come
    last, so that one stays only where its component has nothing else. Rows that are equal in
    id and text count as one. Columns as given; other columns never decide."""
    rows = with_row_key(docs)
    marked = staged(fingerprints(rows, size, "th"), "fingerprints")
    firsts = staged(marked.groupBy("fp").agg(F.min(F.expr(ROW)).alias("first")), "distinct-fp")
    roots = connected_components(near_links(firsts.select("fp"), firsts.count()))
    return kept_rows(docs, representatives(marked, firsts, roots))
