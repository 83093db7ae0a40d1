"""Unigram encoding against all splits of short words and against the library on whole texts."""

import itertools
import random

import pytest

from tallgrass.operators import unigram

ALPHABET = "abcé日1"


def vocabulary(seed, byte_pieces, added=()):
    rnd = random.Random(seed)
    parts = {"".join(rnd.choice(ALPHABET[:5]) for _ in range(rnd.randrange(1, 5))) for _ in range(40)} | {unigram.SPACE, unigram.SPACE + "a", unigram.SPACE + "ab", "a", "b", "1"}
    apart = [*unigram.SPECIAL, *(unigram.BYTES if byte_pieces else ()), *added]
    return unigram.Vocabulary([*((p, 0.0) for p in apart), *((p, -rnd.randrange(8, 72) / 8) for p in sorted(parts))], tuple(added))


def best(v, part):
    """The best score over all splits; single characters may be unknown where no piece is just they."""
    plain = {p: s for p, s in v.rows[len(unigram.SPECIAL) :] if p not in unigram.BYTES}
    top = None
    for cuts in itertools.product([0, 1], repeat=len(part) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(part)]
        score = 0.0
        for a, b in itertools.pairwise(at):
            p = part[a:b]
            score += plain[p] if p in plain else v.floor if b - a == 1 else float("-inf")
        top = score if top is None or score > top else top
    return top


@pytest.mark.parametrize("seed", range(4))
def test_best_of_all_splits(seed):
    v = vocabulary(seed, False)
    scores = dict(v.rows)
    rnd = random.Random(seed)
    for _ in range(150):
        word = "".join(rnd.choice(ALPHABET + "xy") for _ in range(rnd.randrange(1, 9)))
        found = v.split(word)
        assert "".join(p for _, p in found) == word
        assert sum(scores[p] if i != v.unknown else v.floor * len(p) for i, p in found) == pytest.approx(best(v, word))


@pytest.mark.parametrize(("byte_pieces", "added"), [(False, ()), (True, ()), (True, ("[PRE]", "[P", "<m>"))])
def test_equals_the_library(byte_pieces, added):
    spm = pytest.importorskip("sentencepiece")
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    v = vocabulary(9, byte_pieces, added)
    kinds = {"<unk>": 2, "<s>": 3, "</s>": 3} | dict.fromkeys(unigram.BYTES, 6) | dict.fromkeys(added, 4)
    for p, s in v.rows:
        model.pieces.add(piece=p, score=s, type=kinds.get(p, 1))
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte_pieces
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = True
    library = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    rnd = random.Random(2)
    parts = [*ALPHABET, *"abab", " ", " ", "x", "zz", "\U0001f600", *added]
    for _ in range(500):
        words = "".join(rnd.choice(parts) for _ in range(rnd.randrange(40))).split()
        assert [i for w in words for i, _ in v.word(w)] == library.encode(" ".join(words), out_type=int)


def test_counted_vocabulary_and_checks(spark):
    lines = spark.createDataFrame([(1, "abab ab 2024 abab"), (2, None), (3, "  "), (4, "ab zq")], "doc_id int, line string")
    words = unigram.word_counts(lines)
    v = unigram.counted(words, 10, added=("[PRE]",))
    assert [p for p, _ in v.rows[:3]] == list(unigram.SPECIAL) and v.rows[259][0] == "[PRE]" and len(v.rows) == 270
    assert not any(any(c.isdigit() for c in p) and len(p) > 1 for p, _ in v.rows[260:])
    got = {r.doc_id: r.pieces for r in unigram.encoded(lines, v, pieces=True).collect()}
    assert got[2] == [] == got[3] and "".join(got[4]).replace("<0x7A>", "z").replace("<0x71>", "q") == "▁ab▁zq"
    assert [p for p in got[1] if "2" in p or "0" in p or "4" in p] == ["2", "0", "2", "4"] or unigram.BYTES[0x30] in got[1]
    ids = {r.doc_id: r.ids for r in unigram.encoded(lines, v).collect()}
    assert [v.rows[i][0] for i in ids[1]] == got[1]
    row = unigram.checks(words, v).first()
    assert (row.unk_id, row.bos_id, row.eos_id, row.eos_ok, row.unk_rate, row.size) == (0, 1, 2, True, 0.0, 270)
    n = sum(len(p) for p in ids.values())
    assert row.fertility == pytest.approx(n / 6, abs=1e-6)
    bare = unigram.counted(words, 3, byte_pieces=False)
    assert unigram.checks(words, bare).first().unk_rate > 0
    nothing = unigram.checks(words.limit(0), unigram.counted(words.limit(0), 5)).first()
    assert nothing.verdict is False and nothing.unk_rate == 0
