"""Best-fit packing of token sequences, planned on the histogram of lengths.

Texts become pieces of at most the capacity. How many pieces there are of each length is all
that a best-fit-decreasing plan needs: it places counts, not documents, and says which ranks
of a length go to which sequences and where. A piece's rank within its length is the count
of such pieces in the tasks before plus its place in its own task, so nothing is sorted; by
length and rank it takes its planned slot.

The driver holds a count a length and the plan. A plan row ends a length, or leaves open
sequences with less than half the room they had, so there are at most about
3 * capacity * log2(capacity) rows, whatever the corpus.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import small_batches, staged, task_number
from tallgrass.llm.repair import Encoder

CAPACITY = 4096
END_ID = 1
_BATCH_BYTES = 8_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: A pattern whose matches end between a letter and a mark, unless the mark is an apostrophe.
_LETTERS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _word_starts(data: np.ndarray) -> np.ndarray:
    cut = ~_SPACE[data]
    cut[1:] &= _SPACE[data[:-1]]
    return cut


def _letters_and_marks(data: np.ndarray) -> np.ndarray:
    """Where words begin, and the marks after their letters, so that a word before a comma is no other word."""
    cut = _word_starts(data)
    cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    return cut


class WordEncoder(Encoder):
    """A tokenizers file whose pre-tokenizer drops white space: texts are cut before each word (by the
    pattern of letters or marks also after its letters), and each distinct piece (with the spaces
    after it) is encoded once. Other files, those whose
    normalizer could look across a space, and added tokens with a space are applied to
    whole texts, as are added tokens that reach into their surroundings."""

    cuts = staticmethod(_word_starts)

    def __init__(self, path: str, **how):
        super().__init__(path, **how)
        kind = json.loads(self.tokenizer.to_str())
        normal, before = kind["normalizer"] or {}, kind["pre_tokenizer"] or {}
        normal, before = normal.get("normalizers", [normal]), before.get("pretokenizers", [before])
        split = before[0]
        drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "\\s" not in split["pattern"].get("Regex", "\\s").replace("[^\\s", "")
        local = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ") for x in normal)
        rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in before[1:])
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in kind.get("added_tokens") or [])
        self.cuttable = bool(drops and local and rest and plain)
        if drops and split["pattern"].get("Regex") == _LETTERS_OR_MARKS:
            self.cuts = _letters_and_marks

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _block(self, data: np.ndarray, places: np.ndarray) -> list[bytes]:
        return super()._block(np.where(_SPACE[data], np.uint8(0x20), data), places)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, part, rank``, staged: the ids of each text and its end, cut
    only where there are more than ``capacity``; ``ids`` are little-endian uint32, ``rank``
    counts the pieces of that length in the part before."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]):
        part, seen = task_number(), np.zeros(capacity + 1, np.int64)
        encode, end, step = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        rows: list[tuple] = []
        size = 0

        def flush():
            nonlocal rows, size
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, own, part, int(seen[n])))
                    seen[n] += 1
                    size += len(own)
                    if size >= _BATCH_BYTES:
                        yield flush()
        if rows:
            yield flush()

    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return staged(cut.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, rank long"), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts by length. Rows ``length, rank, count, per, sequence, offset``: the
    ``count`` pieces of a length from a rank on go ``per`` to a sequence, from an offset on,
    into sequences one after another from a number on."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> first sequence, sequences
    spaces: list[int] = []  # that are left anywhere, ascending
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if not room[space]:
                insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} in sequences of {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                n = -(-left // (capacity // length))
                leave(capacity, opened, n)
                opened += n
                continue
            space = spaces[at]
            first, n = room[space].pop()
            if not room[space]:
                spaces.pop(at)
            per = space // length
            full = min(n, left // per)
            last = left - full * per if full < n and left - full * per < per else 0
            for each, k in ((per, full), (last, 1 if last else 0)):
                if k:
                    rows.append((length, rank, each * k, each, first, capacity - space))
                    leave(space - each * length, first, k)
                    first, n, rank, left = first + k, n - k, rank + each * k, left - each * k
            leave(space, first, n)
    return np.array(rows, np.int64).reshape(-1, 6)


def slots(planned: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of given lengths and ranks."""
    key = planned[:, 0] << 44 | planned[:, 1]
    order = np.argsort(key)
    row = planned[order[np.searchsorted(key[order], length << 44 | rank, "right") - 1]]
    k = rank - row[:, 1]
    return row[:, 4] + k // row[:, 3], row[:, 5] + k % row[:, 3] * length


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length``, its ``ids`` (little-endian uint32; with
    ``with_ids=False`` their ``ids_crc32`` instead, and the ids are not moved), and its
    place, ``sequence_id, offset``.

    Null and empty texts are one piece of the end id alone; repeated rows and ids are packed
    each for itself; other columns don't count. An empty table gives no rows. A text of more
    ids than ``capacity`` is cut there, and only such.
    """
    found = pieces(docs, tokenizer_path, capacity, end_id)
    shown = "ids" if with_ids else "ids_crc32"
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(found.groupBy("part", "length").agg(F.count("*").alias("c")), "length-counts")
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # capacity rows at most
    planned = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    bases = counts.select("part", "length", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = slots(planned.value, length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, at)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    own = found.select("doc_id", "piece", "start", "length", F.col("ids") if with_ids else F.crc32("ids").alias(shown), "part", "rank")
    ranked = own.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", shown, (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id long, piece int, start long, length long, {shown} {'binary' if with_ids else 'long'}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids, offsets``: the ids of each sequence in one binary, and where its pieces begin;
    a group holds no more than the capacity."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate(F.col("p"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("p.offset").alias("offsets"))
