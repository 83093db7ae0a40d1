"""Packing against best fit piece by piece, and its ids against the library's on whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallgrass.llm import packing, queries
from tallgrass.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def plain_ids(texts):
    return [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain_best_fit(lengths, capacity):
    """Sequences that best fit decreasing needs, placing one piece at a time."""
    room = Counter()
    opened = 0
    for n in sorted(lengths, reverse=True):
        fits = [space for space, k in room.items() if k and space >= n]
        if fits:
            space = min(fits)
            room[space] -= 1
        else:
            space, opened = capacity, opened + 1
        room[space - n] += 1
    return opened


def placed(rows, capacity):
    """Sequences by number; every piece has its place, gapless, and none is over the capacity."""
    held = defaultdict(list)
    for r in rows:
        held[r[0]].append(r[1:])
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return held


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_as_best_fit_does(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 16, 100, 128])
    lengths = [rnd.choice([rnd.randint(1, capacity), min(capacity, 1 + int(rnd.expovariate(0.1))), capacity, 1]) for _ in range(rnd.choice([0, 1, 50, 700]))]
    counts = Counter(lengths)
    planned = packing.plan(dict(counts), capacity)
    assert len(planned) <= max(2, 3 * capacity * capacity.bit_length())
    rows = []
    for n, c in counts.items():
        seq, at = packing.slots(planned, np.full(c, n, np.int64), np.arange(c))
        rows += zip(seq.tolist(), at.tolist(), [n] * c, strict=True)
    assert len(placed(rows, capacity)) == plain_best_fit(lengths, capacity)


TEXTS = [
    None, "", " \n\t ", "It's we'll THE café École ΣΣ İstanbul", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "x y z ́combining ́", "a\x1cb\x0bc\x85d", "12 345 a1b2 !!! ... \U0001f600\U0001f600 한국 한",
    "don't can't 's ' s '", " line ", "trailing   ", "   leading", "ﬁ ẞ ǅ",
]


def test_encoder_equals_the_library():
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice("ab'sT1 \né́!<|　Å") for _ in range(rnd.randrange(60))) for _ in range(2000)]
    encode = packing.WordEncoder(PATH)
    assert encode.cuttable
    for texts in (TEXTS, mixed):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode.encode(texts)] == [x[:-1] for x in plain_ids(texts)]
    assert not packing.WordEncoder(tokenizer_path()).cuttable


def test_query_equals_its_contract(spark, documents):
    got = queries.op13_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"]
    got = got.collect()
    docs = documents.collect()
    want = []
    for d, ids in zip(docs, plain_ids([d.text for d in docs]), strict=True):
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((d.doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held = placed([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert len(held) == plain_best_fit([r[3] for r in want], 4096)


def test_odd_rows(spark, odd, nothing):
    got = packing.packed(odd, PATH, capacity=100).cache()
    rows = got.collect()
    want = Counter()
    for r, ids in zip(texts := odd.collect(), plain_ids([r.text for r in texts]), strict=True):
        want.update((r.doc_id, k, at, tuple(ids[at : at + 100])) for k, at in enumerate(range(0, len(ids), 100)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    held = placed([(r.sequence_id, r.offset, r.length) for r in rows], 100)
    found = packing.sequences(got).collect()
    own = {(r.sequence_id, r.offset): r.ids for r in rows}
    for s in found:
        assert s.offsets == sorted(o for o, _ in held[s.sequence_id]) and bytes(s.ids) == b"".join(own[s.sequence_id, o] for o in s.offsets)
    assert len(found) == len(held)
    assert packing.packed(nothing, PATH).count() == 0


def test_a_word_before_a_mark_is_no_other_word():
    """Ids stay the library's, and a word is encoded once whatever mark follows it."""
    rnd = random.Random(8)
    marks = ["'", "'s", "'LL", ",", "...", "=\u0338", "-", "_", "\u0301", "\u00e9", "7", " ", "\n", "<|endoftext|>", "<|", "\u4e2d", "\u2019"]
    texts = ["".join(rnd.choice(["word", "Ab", "x", "s", "", *marks]) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    made = packing.WordEncoder(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)]
    assert [[*x, 1] for x in got] == plain_ids(texts)
    few = packing.WordEncoder(PATH)
    few.encode([" ".join(f"again{m}" for m in (",", ".", ";", "!", "?", ":", ""))])
    assert sum(w.startswith("again") for w in few.known) <= 2
