"""Token-id shards compressed by Re-Pair.

Documents are dealt by ranges of doc_id, encoded, and written in ascending order as
shard files. In a shard, frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round; the file stores the rules, each rule's expansion
length and the place of every document, so any document can be decoded by itself.

Shard file, little-endian: magic ``RPG1``; six uint64: documents, symbols, rules, first
nonterminal, symbol width in bytes, ids; then doc_id int64 (documents), has_id uint8
(documents), symbol offset uint64 (documents + 1), id offset uint64 (documents + 1),
rules uint32 (rules x 2), expansion length uint32 (rules), symbols.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import new_path, partitions, small_batches, staged, store_of, task_number

END_ID = 0
SHARD_IDS = 2_000_000
ROUNDS = 12
PAIRS_A_ROUND = 512
LEAST_COUNT = 12
_HEAD = 4 + 6 * 8
_PLAIN = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch  # letters in every version of Unicode


def _byte_alphabet() -> np.ndarray:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and numbers the others from
    256: the UTF-16 unit of each byte."""
    units = np.arange(256)
    odd = (units < 0x21) | ((units > 0x7E) & (units < 0xA1)) | (units == 0xAD)
    return np.where(odd, 255 + np.cumsum(odd), units).astype("<u2")


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a byte-level pre-token surely ends and another begins.

    They are: after a letter, before an ASCII byte that is none; before a single space, and
    on both sides of a single line feed, that stand between characters that are no white
    space. A place that these rules leave out only makes a chunk longer.
    """
    ascii_letter = np.zeros(256, bool)
    ascii_letter[np.r_[65:91, 97:123]] = True
    latin = np.zeros(256, bool)  # second bytes of Latin-1 letters
    latin[np.r_[0x80:0x97, 0x98:0xB7, 0xB8:0xC0]] = True
    starts = np.zeros(256, bool)  # first bytes of characters that are never white space
    starts[np.r_[0x21:0x80, 0xC3:0xE1, 0xE4:0x100]] = True
    letter = ascii_letter[data]
    ended = letter.copy()
    ended[1:] |= (data[:-1] == 0xC3) & latin[data[1:]]
    solid = data >= 0x21  # the last byte of a character that is no white space
    solid[1:] &= ~((data[:-1] == 0xC2) & (data[1:] >= 0x80))
    solid[2:] &= ~((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[2:] >= 0x80))
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ended[:-1] & (data[1:] < 0x80) & ~letter[1:]
    between = solid[:-2] & starts[data[2:]]
    cut[1:-2] |= between & ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A))
    cut[2:-1] |= between & (data[1:-1] == 0x0A)
    return cut[:-1]


class Encoder:
    """A byte-level BPE file of the tokenizers library with a bounded memo of chunks.

    Texts are cut where pre-tokens end (``_cuts``); each distinct chunk of a block is encoded
    once and the ids are gathered, so results equal those of whole texts. A text that holds
    the string of an added token is first cut there, as the library does, and the token's own
    id stands between the parts. Files with another kind of pre-tokenisation, or with added
    tokens that reach into their surroundings, are applied to whole texts.
    """

    cuts = staticmethod(_cuts)

    def __init__(self, path: str, memo: int = 800_000, longest: int = 48, block: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.longest, self.block = memo, longest, block
        self.known: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab()
        self.alphabet = _byte_alphabet()
        space = chr(self.alphabet[0x20])
        self.spaced = np.zeros(max(words.values()) + 1, bool)
        self.spaced[[i for w, i in words.items() if w[0] == space]] = True
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.cuttable = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex"), kind["normalizer"]) == ("ByteLevel", False, True, None)
        added = kind.get("added_tokens") or []
        self.cuttable &= not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.bare = Tokenizer(self.tokenizer.model)  # for words already in the byte alphabet
        self.bare.pre_tokenizer = pre_tokenizers.Split(space, "merged_with_next")

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. A space and letters are one pre-token, so such chunks are joined
        and go straight to the merges: a token there begins with a space just where a chunk does."""
        out: dict[str, bytes] = {}
        plain = [c for c in chunks if _PLAIN(c)]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            text = self.alphabet[np.frombuffer("".join(part).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) != len(part):
                raise ValueError("tokens don't follow the chunks")
            data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
            out.update(zip(part, (data[i:j] for i, j in zip((4 * cuts).tolist(), ends, strict=True)), strict=True))
        rest = [c for c in chunks if c not in out]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(rest, found, strict=True))
        return [out[c] for c in chunks]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null is empty."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        if not len(column):
            return []
        if not self.cuttable:
            found = self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        if self.marks is not None:
            marked = pc.match_substring_regex(column, self.marks.pattern)
            if pc.any(marked).as_py():
                return self._around_marks(column.to_pylist())
        return self._plain(column)

    def _around_marks(self, texts: list[str]) -> list[bytes]:
        """Texts of which some hold strings of added tokens: the parts between are encoded by themselves."""
        cut = [self.marks.split(t) for t in texts]
        parts = [p for pieces in cut for p in pieces[::2]]
        found = iter(self._plain(pa.array(parts, pa.large_string())))
        return [b"".join(next(found) if k % 2 == 0 else self.added[p] for k, p in enumerate(pieces)) for pieces in cut]

    def _plain(self, column: pa.Array) -> list[bytes]:
        """Ids of texts without added tokens."""
        _, places, data = column.buffers()
        places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out: list[bytes] = []
        k = 0
        while k < len(column):  # blocks of whole texts; a longer text is a block by itself
            end = max(k + 1, int(np.searchsorted(places, places[k] + self.block, "right")) - 1)
            out += self._block(data[places[k] : places[end]], places[k : end + 1] - places[k])
            k = end
        return out

    def _block(self, data: np.ndarray, places: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(places) - 1)
        cut = self.cuts(data)
        cut[places[:-1][places[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.r_[starts, len(data)]
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > self.memo:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self._ids(new), strict=True))
        found = [self.known[w] for w in words]
        for w in new:
            if len(w) > self.longest:
                del self.known[w]
        flat = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = chunks.indices.to_numpy()
        n = length[which]
        ends = np.r_[0, np.cumsum(n)]
        shift = (np.cumsum(length) - length)[which] - ends[:-1]
        ids = flat[np.repeat(shift, n) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[np.searchsorted(starts, places)]).tolist()
        return [ids[i:j] for i, j in zip(at, at[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Grammar:
    first: int
    rules: np.ndarray  # n x 2
    lengths: np.ndarray  # n


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519))) >> np.uint32(14)


def _chosen(keys: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """The most frequent pairs whose replacements can't overlap: no symbol stands left in
    one and right in another, or in a pair of equal symbols and in any other."""
    left: set[int] = set()
    right: set[int] = set()
    out: list[int] = []
    for k in np.lexsort((keys, -counts.astype(np.int64))).tolist():
        a, b = int(keys[k]) >> 32, int(keys[k]) & 0xFFFFFFFF
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a)
        right.add(b)
        if a == b:
            left.add(b)
            right.add(a)
        out.append(int(keys[k]))
        if len(out) == most:
            break
    return out


def compress(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int = ROUNDS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Symbols, the end of each document among them, and the grammar.

    ``ends`` are document ends in ``ids`` (each above the one before): no pair crosses one.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        if len(seq) < 2:
            break
        open_ = np.flatnonzero(~last[:-1])
        bucket = _bucket(seq[:-1], seq[1:])
        counts = np.bincount(bucket[open_], minlength=1 << 18)
        floor = max(least, int(np.partition(counts, -PAIRS_A_ROUND)[-PAIRS_A_ROUND]))
        spots = open_[counts[bucket[open_]] >= floor]  # pairs of frequent buckets; their exact counts follow
        if not len(spots):
            break
        keys = seq[spots].astype(np.uint64) << np.uint64(32) | seq[spots + 1]
        found, n = np.unique(keys, return_counts=True)
        pairs = _chosen(found[n >= least], n[n >= least], PAIRS_A_ROUND)
        if not pairs:
            break
        wanted = np.array(sorted(pairs), np.uint64)
        near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[near] == keys
        spots, near = spots[hit], near[hit]
        # a run of one symbol: from its start, every other place
        start = np.r_[True, spots[1:] != spots[:-1] + 1]
        begun = np.maximum.accumulate(np.where(start, np.arange(len(spots)), 0))
        spots, near = (lambda even: (spots[even], near[even]))((np.arange(len(spots)) - begun) % 2 == 0)
        seq[spots] = (first + len(rules) + near).astype(np.uint32)
        last[spots] = last[spots + 1]
        keep = np.ones(len(seq), bool)
        keep[spots + 1] = False
        before = len(seq)
        seq, last = seq[keep], last[keep]
        rules += [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in wanted.tolist()]
        if before - len(seq) < before // 200:
            break
    table = np.array(rules, np.uint32).reshape(-1, 2)
    lengths = np.ones(first + len(table), np.int64)
    for k, (a, b) in enumerate(table.tolist()):
        lengths[first + k] = lengths[a] + lengths[b]
    return seq, np.flatnonzero(last) + 1, Grammar(first, table, lengths[first:].astype(np.uint32))


class Expansion:
    """The ids that each symbol stands for, laid out once, so that decoding is a gather."""

    def __init__(self, grammar: Grammar):
        first, n = grammar.first, grammar.lengths.astype(np.int64)
        self.length = np.r_[np.ones(first, np.int64), n]
        self.at = np.r_[np.arange(first), first + np.r_[0, np.cumsum(n)[:-1]]] if len(n) else np.arange(first)
        self.flat = np.empty(first + int(n.sum()), np.uint32)
        self.flat[:first] = np.arange(first)
        for k, (a, b) in enumerate(grammar.rules.tolist()):
            to, la, lb = int(self.at[first + k]), int(self.length[a]), int(self.length[b])
            self.flat[to : to + la] = self.flat[self.at[a] : self.at[a] + la]
            self.flat[to + la : to + la + lb] = self.flat[self.at[b] : self.at[b] + lb]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        if not len(n):
            return np.zeros(0, np.uint32)
        shift = self.at[symbols] - np.r_[0, np.cumsum(n)[:-1]]
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


def pack(doc_ids: list[int | None], parts: list[bytes], first: int) -> bytes:
    """One shard file. ``parts`` are the documents' ids as uint32 bytes, ends included."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.cumsum([len(p) // 4 for p in parts])
    first = max(first, int(ids.max()) + 1)
    seq, cuts, grammar = compress(ids, ends, first)
    width = 2 if first + len(grammar.rules) <= 1 << 16 else 4
    head = np.array([len(parts), len(seq), len(grammar.rules), first, width, len(ids)], "<u8")
    return b"".join([
        b"RPG1", head.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.r_[0, cuts].astype("<u8").tobytes(), np.r_[0, ends].astype("<u8").tobytes(),
        grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """A shard file in memory; documents are decoded one by one or in blocks."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a shard file")
        docs, symbols, rules, first, width, self.ids = (int(x) for x in np.frombuffer(data, "<u8", 6, 4))
        at = _HEAD

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.cuts, self.offsets = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        self.grammar = Grammar(first, take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules))
        self.symbols = take(f"<u{width}", symbols)
        if at != len(data):
            raise ValueError("a shard file of the wrong length")
        self.expansion = Expansion(self.grammar)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id included."""
        out = self.expansion.expand(self.symbols[self.cuts[k] : self.cuts[k + 1]])
        if len(out) != self.offsets[k + 1] - self.offsets[k]:
            raise ValueError("a document that doesn't expand to its length")
        return out

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document: the stored expansion lengths tell which
        symbols reach into the range, and no others are expanded."""
        symbols = self.symbols[self.cuts[k] : self.cuts[k + 1]]
        ends = np.cumsum(self.expansion.length[symbols])
        stop = min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, [start, stop - 1], "right")
        before = int(ends[a - 1]) if a else 0
        return self.expansion.expand(symbols[a : b + 1])[start - before : stop - before]


def read_document(uri: str, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard file, read by ranges: head, the document's places,
    the rules, and its own symbols; the other documents' symbols are never read."""
    store, name = store_of(uri)
    with store.open_input_file(name) as f:
        head = f.read(_HEAD)
        if head[:4] != b"RPG1":
            raise ValueError("not a shard file")
        docs, _, rules, first, width, _ = (int(x) for x in np.frombuffer(head, "<u8", 6, 4))
        if not 0 <= k < docs:
            raise IndexError(k)

        def take(at: int, kind: str, n: int) -> np.ndarray:
            f.seek(at)
            return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)

        cuts_at = _HEAD + 9 * docs
        rules_at = cuts_at + 16 * (docs + 1)
        a, b = take(cuts_at + 8 * k, "<u8", 2).astype(np.int64)
        i, j = take(cuts_at + 8 * (docs + 1) + 8 * k, "<u8", 2).astype(np.int64)
        grammar = Grammar(first, take(rules_at, "<u4", 2 * rules).reshape(-1, 2), take(rules_at + 8 * rules, "<u4", rules))
        out = Expansion(grammar).expand(take(rules_at + 12 * rules + int(a) * width, f"<u{width}", int(b - a)))
    if len(out) != j - i:
        raise ValueError("a document that doesn't expand to its length")
    return out


def write_shards(docs: DataFrame, tokenizer_path: str, out: str | None = None, shard_ids: int = SHARD_IDS, vocabulary: int = 50_257) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into shard files below ``out`` (by default in the shared
    folder) and returns their staged manifest ``part, seq, path, n_docs, n_ids``.

    Null text is empty: its end id alone. Null doc_ids sort first, repeated ones by text;
    an empty table writes no file. File names are new for each attempt of a task, and the
    manifest lists the files of the attempts that counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = out or new_path(spark, "id-shards")
    if "://" not in out or out.startswith("file:"):
        store, path = store_of(out)
        store.create_dir(path, recursive=True)

    def run(batches):
        part, seq = task_number(), 0
        encode = encoder(tokenizer_path)
        store, base = store_of(out)
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush():
            nonlocal ids, parts, size, seq
            name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.rpg"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(pack(ids, parts, vocabulary))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{out}/{name}"], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size // 4], pa.int64())}
            )
            ids, parts, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1)), strict=True):
                ids.append(doc_id)
                parts.append(found + end)
                size += len(found) + 4
                if size >= 4 * shard_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "id-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all shards before: sums by part first, so that
    the one ordered window holds a row a part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("_before")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = store_of(path)
                with store.open_input_stream(name) as f:
                    shard = Shard(f.read())
                crc = [zlib.crc32(shard.document(k).astype("<u4", copy=False).tobytes()) for k in range(len(shard))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(start + shard.offsets[:-1]), pa.array(np.diff(shard.offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = with_starts(manifest).select("path", "start").repartition(partitions(manifest.sparkSession))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Writes the shards of ``docs`` and reads them back: one row a document."""
    return read_shards(write_shards(docs, tokenizer_path, **how))
