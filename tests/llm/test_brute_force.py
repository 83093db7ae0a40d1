"""Operators that SQL can't express, against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallgrass.llm import pii, repair, rules, simhash, similar, suffix, tiling
from tallgrass.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- quality rules ---------------------------------------------------------------------------------


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_base_statistics(request, name):
    df = request.getfixturevalue(name)
    got = rows(rules.with_statistics(df).select("text", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"))
    assert got
    for text, *stats in got:
        assert tuple(stats) == base(text)


def test_decision_list_finds_a_planted_rule_and_keeps_clean_rows(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(900)]
    docs, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(rnd.choice(words) + ("$$$" if bad and rnd.random() < 0.7 else "") for _ in range(80))
        docs.append((i, text))
        marks.append((i, 0 if bad else 1))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    found = rules.learn(d, m)
    assert found and found[0].conditions[0].feature == "symbols_per_word"
    got = {r["doc_id"]: r["_kept"] for r in rules.judged(d, m).collect()}
    assert sum(got[i] != (i % 5 != 0) for i in got) <= 4
    assert all(got[i] for i in got if i % 5)


def test_rules_without_labels_and_odd_rows(odd, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn(odd, none) == []
    assert rules.judged(nothing, none).count() == 0
    got = rules.judged(odd, none)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert got.filter("_kept IS NULL").count() == 0


# --- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: list of (doc_id, fingerprint). Smallest id of each fingerprint's component."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, f in fps:
        r = find(f)
        least.setdefault(r, None)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return {f: least[find(f)] for f in distinct}


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_simhash_against_all_pairs(request, name):
    df = request.getfixturevalue(name)
    want = [(d, plain_fingerprint(t)) for d, t in rows(df.select("doc_id", "text"))]
    comp = plain_components(want)
    got = rows(simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(((d, f"{f:016x}", comp[f]) for d, f in want), key=key)


def test_simhash_links_on_close_random_fingerprints(spark):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    fps = {s for s in seeds}
    for s in seeds[:12]:
        for _ in range(25):
            s ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                s ^= 1 << rnd.randrange(64)
            fps.add(s)
    for b in range(64):  # one dense ball, longer than a short run
        fps.add(seeds[-1] ^ (1 << b))
        fps.add(seeds[-2] ^ (7 << b) & (1 << 64) - 1)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    for count, dense in ((len(signed), None), (1 << 30, None), (len(signed), 40), (len(signed), 3)):  # few and many blocks, and buckets too dense to compare
        pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in rows(simhash.near_links(df, count, dense))]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        assert parted(fps, pairs) == parted(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])


def parted(nodes, pairs):
    """The least node of each node's component."""
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {f: find(f) for f in nodes}


def test_components(spark):
    rnd = random.Random(12)
    pairs = [(k, k + 1) for k in range(40)] + [(50, 60 + k) for k in range(80)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(90)] + [(7, 7), (200, 200)]
    from tallgrass.llm.components import connected_components

    got = dict(rows(connected_components(spark.createDataFrame([*pairs, *(p[::-1] for p in pairs[::3]), (None, 3)], "a long, b long"))))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = parted({x for p in pairs for x in p}, pairs)
    assert got == {x: want[x] for x in linked}


ROWS = [
    (1, "t t t t t t", "a", 1), (None, "t t t t t t", "b", 1), (None, "u u v u u w", "c", 1), (6, "six words are in this text", "d", 1), (6, "and six others stand in here now", "e", 1),
    (6, "six words are in this text", "f", 1), (None, "u u v u u w", "g", 1), (9, None, "h", 1), (None, None, "i", 1),
]


@pytest.mark.parametrize("stage", [simhash.one_of_each, similar.one_of_each])
def test_rows_are_judged_one_by_one(spark, stage):
    """Null and repeated ids: a component's row with the least id stays, whatever other rows without an id there are."""
    for order in (ROWS, ROWS[::-1], [r for r in ROWS if r[1] != "u u v u u w"]):
        df = spark.createDataFrame(order, "doc_id long, text string, th string, row long")
        got = stage(df)
        assert got.columns == df.columns
        want = {(1, "t t t t t t"), (6, "six words are in this text"), (6, "and six others stand in here now"), (9, None), (None, "u u v u u w")}
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want & {r[:2] for r in order}, key=str)


def test_long_runs_link_as_all_pairs(spark):
    rnd = random.Random(6)
    fps = np.array(sorted({rnd.getrandbits(64) & 0xFF0F for _ in range(900)}), np.uint64)
    a, b = simhash._long_run(fps, 64)
    pairs = list(zip(a.tolist(), b.tolist()))
    assert all((x ^ y).bit_count() <= 2 for x, y in pairs) and len(pairs) < len(fps)
    every = fps.tolist()
    assert parted(every, pairs) == parted(every, [(x, y) for x in every for y in every if (x ^ y).bit_count() <= 2])


def test_one_of_each(spark, odd, nothing):
    got = rows(simhash.one_of_each(odd))
    ids = [r[0] for r in got if r[0] is not None]
    assert len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and 8 in ids and 9 not in ids
    assert simhash.one_of_each(odd).columns == odd.columns
    assert simhash.one_of_each(nothing).count() == 0


# --- suffix sorting --------------------------------------------------------------------------------


def plain_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_is_the_sorted_order():
    rnd = random.Random(1)
    for n in [*range(30), 100, 301]:
        for sigma in (1, 2, 4, 200):
            s = np.array([rnd.randrange(sigma) for _ in range(n)], np.int64)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("many", [512, 2])
def test_suffix_dedup_against_all_windows(spark, monkeypatch, many):
    monkeypatch.setattr(suffix, "MANY", many)
    rnd = random.Random(7)
    rand = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared, other = rand(130), rand(90)
    texts = [rand(200), None, "", rand(39), rand(40), rand(300) + shared, shared + rand(100), rand(50) + shared[10:100] + rand(60), other * 3, rand(20) + other + rand(9), "a" * 200]
    texts += [texts[0], texts[4], rand(120) + shared[:45] + shared[40:] + rand(30)]
    texts += [rand(rnd.randrange(80)) + shared[rnd.randrange(40) :] + rand(rnd.randrange(90)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    got = sorted(rows(suffix.deduplicated(df, length=40, anchor=12).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")))
    assert got == [(i, *x) for i, x in enumerate(plain_removed(texts, 40))]


@pytest.mark.parametrize("length,first", [(40, 46), (47, 4), (400, 46)])
def test_distributed_difference_cover_against_all_windows(spark, length, first):
    rnd = random.Random(length)
    base = bytes(rnd.choice(b"ab") for _ in range(4 * length))
    pieces = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(9))) + base[(k := rnd.randrange(3 * length)) : k + length + rnd.randrange(length)] + bytes([120 + j % 5]) * (j % 7) for j in range(60)}
    pieces |= {b"a" * (2 * length), b"ab" * length, b"", b"z" * (length - 1), b"q" * length}
    listed = sorted(pieces)
    count = Counter(d[i : i + length] for d in listed for i in range(len(d) - length + 1))
    want = {(k, i) for k, d in enumerate(listed) for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1}
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(listed)], "pid long, data binary").repartition(3)
    got = rows(suffix.distributed_repeats(df, length, [], first))
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_names_of_near_copies_do_not_grow_with_the_copies(spark):
    """Strings that stand once, as each copy's changed bytes make, have no name, and no repeated window is lost."""
    rnd, length, first, named = random.Random(4), 60, 12, {}
    text = bytes(rnd.randrange(256) for _ in range(600))
    for copies in (20, 60):
        pieces = []
        for pid in range(copies):
            copy = bytearray(text[rnd.randrange(3) :])
            for at in rnd.sample(range(len(copy) - 8), 3):
                copy[at : at + 8] = bytes(rnd.randrange(256) for _ in range(8))
            pieces.append((pid, bytes(copy)))
        count = Counter(d[i : i + length] for _, d in pieces for i in range(len(d) - length + 1))
        paths = []
        got = rows(suffix.distributed_repeats(spark.createDataFrame(pieces, "pid long, data binary"), length, paths, first))
        assert sorted(got) == [(p, i) for p, d in pieces for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1]
        assert len(got) < sum(count.values())
        named[copies] = spark.read.parquet(paths[0]).count()
    assert named[60] <= 1.2 * named[20] and named[60] <= 2 * len(text)


def test_suffix_dedup_on_documents_and_odd_rows(documents, odd, nothing):
    some = documents.filter("length(text) < 3000")
    pairs = rows(some.select("doc_id", "text").orderBy("doc_id"))
    got = sorted(rows(suffix.deduplicated(some).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")))
    assert got == [(d, *x) for (d, _), x in zip(pairs, plain_removed([t for _, t in pairs], 400), strict=True)]
    assert suffix.deduplicated(nothing).count() == 0
    got = suffix.deduplicated(odd)
    assert got.count() == odd.count()
    assert {r[0] for r in rows(got.filter("n_removed = n_bytes AND n_bytes > 0").select("doc_id"))} == {8, 9}


# --- token ids -------------------------------------------------------------------------------------


def test_token_ids_against_the_tokenizer(spark, documents, odd, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    tricky = ["a  b", " lead", "trail ", "x \n y", "tab\t sep", "it's we 're", "a b c", "q\x1c r s", "é é", "<|endoftext|> z", "1 22 333", "  ", "日本 語 x", "!" * 40, "a " * 50, "ab" * 400]
    extra = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(tricky)], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(extra).unionByName(odd.filter("doc_id IS NOT NULL AND doc_id <> 6").select(F.col("doc_id") + 20_000, "text").toDF("doc_id", "text"))
    assert t.encode("a<|endoftext|>", add_special_tokens=False).ids[-1] == 50256  # the library's plain reading
    want, at = [], 0
    for d, text in sorted(rows(df)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = repair.encoded(df, tokenizer_path(), shard_ids=5000)
    assert sorted(rows(got.select("doc_id", "start", "n_tokens", "ids_crc32"))) == want
    assert repair.encoded(nothing, tokenizer_path()).count() == 0
    assert repair.encoded(odd, tokenizer_path()).count() == odd.count()


def test_chunked_encoding_equals_whole_texts():
    pieces = [*"ab zZ  \n\n\t.,'’stredlm123-_é×÷ñ日本ß́\r\x7f\x1c\x00\x85\xa0\u1680\u2003\u2028\u202f\u3000🎉", "'s", "'ll", " word", " über", "<|endoftext|>"]
    rnd, encoder = random.Random(3), repair.Encoder(tokenizer_path(), memo=3000)
    for _ in range(30):
        encoder.block = rnd.choice([1, 50, 8_000_000])
        texts = [None if rnd.random() < 0.05 else "".join(rnd.choices(pieces, k=rnd.choice([0, 1, 2, 3, 8, 40, 300]))) for _ in range(150)]
        want = encoder.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
        assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in want]
    assert encoder.encode([]) == []
    column = pa.array(["a b", "x", None, "cc dd"])
    assert encoder.encode(column.slice(1)) == encoder.encode(column.to_pylist())[1:]


def test_repair_round_trip_and_random_access():
    rnd = random.Random(2)
    base = [rnd.randrange(300) for _ in range(9)]
    docs = [[rnd.choice(base) for _ in range(rnd.randrange(400))] + [0] for _ in range(60)] + [[7] * 1000 + [0], [0], base * 150 + [0]]
    parts = [np.array(d, "<u4").tobytes() for d in docs]
    shard = repair.Shard(repair.pack(list(range(len(docs))), parts, 300))
    assert len(shard.grammar.rules) > 0 and len(shard.symbols) < sum(map(len, docs)) / 2
    for k in rnd.sample(range(len(docs)), len(docs)):
        assert shard.document(k).tolist() == docs[k]
    for k in range(len(docs)):
        i = rnd.randrange(len(docs[k]) + 1)
        j = rnd.randrange(i, len(docs[k]) + 3)
        assert shard.tokens(k, i, j).tolist() == docs[k][i:j]
    lengths = shard.grammar.lengths.tolist()
    size = lambda s: 1 if s < shard.grammar.first else lengths[s - shard.grammar.first]
    assert all(n == size(a) + size(b) for n, (a, b) in zip(lengths, shard.grammar.rules.tolist(), strict=True))


def test_documents_are_read_by_ranges(spark, documents, tmp_path):
    manifest = repair.write_shards(documents, tokenizer_path(), f"file://{tmp_path}/ids", shard_ids=20_000)
    for path in [r["path"] for r in manifest.collect()][:3]:
        with open(path.removeprefix("file://"), "rb") as f:
            shard = repair.Shard(f.read())
        for k in (0, len(shard) // 2, len(shard) - 1):
            assert repair.read_document(path, k).tolist() == shard.document(k).tolist()
        with pytest.raises(IndexError):
            repair.read_document(path, len(shard))


# --- string tiling ---------------------------------------------------------------------------------


def plain_tiling(a, b, least):
    """Greedy string tiling as first published: rescan for the longest unmarked matches."""
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least, []
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [True] * best
                tiles.append((i, j, best))


def test_tiling_against_the_plain_algorithm():
    rnd = random.Random(4)
    for case in range(60):
        item = [rnd.randrange(1, 9 if case % 2 else 60) for _ in range(rnd.randrange(5, 40))]
        parts = [item[i : i + 9] for i in range(0, len(item), 9)]
        rnd.shuffle(parts)
        doc = [x for p in parts for x in [*p, *[0] * rnd.randrange(3)]]
        a, b = np.array(doc), np.array(item)
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if (a[i : i + 5] == b[j : j + 5]).all()]
        got, want = tiling.tiles(a, b, seeds, 5), plain_tiling(doc, item, 5)
        assert sorted(got) == sorted(want)


def plain_matches(docs, items):
    """Every document against every item, by the plain tiling; short items must stand whole in the text."""
    out = []
    for d, text in docs:
        a = tiling.words(text)
        for i, item in items:
            b = tiling.words(item)
            if not a or not b:
                continue
            found = plain_tiling(a, b, min(5, len(b)))
            if sum(n for *_, n in found) >= 0.8 * len(b):
                out.append((d, i, round(sum(n for *_, n in found) / len(b), 9), len(found)))
    return sorted(out)


def test_matches_against_every_pair(spark, monkeypatch):
    rnd = random.Random(15)
    common = ["of the and so on", "it is said that he"]
    word = lambda: rnd.choice("the of and so on it is said that he lorem ipsum dolor sit amet".split())
    items = [(k, " ".join(word() if rnd.random() < 0.6 else f"w{rnd.randrange(40)}" for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 33])]
    items += [(20 + k, f"{rnd.choice(common)} x{k} y{k} z{k} {common[k % 2]}") for k in range(6)] + [(40, None), (41, "..."), (42, "Unheard-of!")]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rnd.randrange(4, 30))]
        for _ in range(rnd.randrange(3)):
            w = (rnd.choice(items)[1] or "").split()
            cut = rnd.randrange(len(w) + 1)
            text += [*w[cut:], *["zzz"] * rnd.randrange(2), *w[:cut]]
        docs.append((k, " ".join(text)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(docs, items)
    found = lambda: sorted((r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles) for r in tiling.matches(d, b).collect())
    assert len(want) > 30 and found() == want
    monkeypatch.setattr(tiling.blocks, "__defaults__", (300,))
    assert found() == want


def test_rows_are_decontaminated_one_by_one(spark):
    item = "one two three four five six seven eight nine ten"
    rows_ = [(1, "clean text", "a"), (1, f"so {item} it is", "b"), (None, f"so {item} it is", "c"), (None, "other clean text", "d"), (None, None, "e"), (2, "a yes no b", "f"), (3, "a yes or no", "g")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, th string")
    got = tiling.decontaminated(df, spark.createDataFrame([(1, item), (2, "Yes, no!"), (3, None)], "item_id long, text string"))
    assert got.columns == df.columns and sorted(r.th for r in got.collect()) == ["a", "d", "e", "g"]


def test_reordered_passages_are_caught_and_clean_documents_left_alone(spark, odd, nothing):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, "too short"), (9, None), (9, None)]
    halves = lambda t: " ".join([*t.split()[15:], "then,", *t.split()[:15]])
    docs = [(i, " ".join(word() for _ in range(200)) + " " + (halves(items[i][1]).upper() if i < 8 else "") + " " + word()) for i in range(16)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(rows(tiling.matches(d, b).select("doc_id", "item_id", "n_tiles")))
    assert got == [(i, i, 2) for i in range(8)]
    assert sorted(r[0] for r in rows(tiling.decontaminated(d, b).select("doc_id"))) == list(range(8, 16))
    assert tiling.matches(nothing, b).count() == 0 and tiling.decontaminated(odd, b).count() == odd.count()
    assert tiling.matches(d, b.filter("item_id > 99")).count() == 0
    monkey = tiling.BLOCK_BYTES
    try:
        tiling.blocks.__defaults__ = (300,)
        assert sorted(rows(tiling.matches(d, b).select("doc_id", "item_id", "n_tiles"))) == got
    finally:
        tiling.blocks.__defaults__ = (monkey,)


# --- surrogates ------------------------------------------------------------------------------------


def test_surrogates(spark, odd, nothing):
    mail, card, phone = "jo.doe77@mail3.example.com", "4929348385146306", "+1 (017) 555-7713"
    secret = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [
        f"Write to {mail} or {phone}.", f"Again {mail.upper()}!! card {card} and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f'token = "{secret}" at 129.38.82.176',
        "9999999999999999 and 1234567812345678 and 999.1.1.1 are no entities, nor v1.2.3", "Mrs Smith met Dr. James Smith; Мария Петрова too.", None, "", "plain text",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["text"] for r in pii.anonymised(df).collect()}
    assert got[3] == texts[3] and got[5] is None and got[6] == "" and got[7] == "plain text"
    for x in (mail, mail.upper(), card, phone, secret, "129.38.82.176", "Smith", "Петрова"):
        assert not any(x in (t or "") for t in got.values())
    new_mail = re.search(r"Write to (\S+) or", got[0])[1]
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com", new_mail)
    assert new_mail.upper()[:-4] in got[1].upper()  # one entity, one surrogate
    assert re.search(r"or \+[1-9] \(\d{3}\) \d{3}-\d{4}\.$", got[0])
    a, b = re.search(r"card (\d{16}) and ([\d ]{19})", got[1]).groups()
    assert a == b.replace(" ", "") and a[0] == "4"
    digits = [int(c) for c in reversed(a)]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}" at \d+\.\d+\.\d+\.\d+$', got[2])
    m = re.fullmatch(r"Mrs (\S+) met Dr\. (\S+) (\S+); (\S+) (\S+) too\.", got[4])
    assert m[1] == m[3] and m[2] in pii.NAMES["latin", "m"] and m[4] in pii.NAMES["cyrillic", "f"]
    assert pii.anonymised(nothing).count() == 0
    same = pii.anonymised(odd)
    assert same.count() == odd.count() and same.filter("_n_entities > 0").count() == 0 and same.columns[:4] == odd.columns


def test_colliding_draws_are_drawn_again(spark, monkeypatch):
    real = pii._stream
    # so few streams that 30 entities must collide at first
    monkeypatch.setattr(pii, "_stream", lambda k, kind, n, a: F.sha2(F.concat(F.pmod(F.xxhash64(real(k, kind, n, a)), F.lit(40)).cast("string"), F.lit("s")), 512))
    df = spark.createDataFrame([(i, f"mail user{i:03d}@host.example.org now") for i in range(30)], "doc_id long, text string")
    got = [r["text"].split()[1] for r in pii.anonymised(df).collect()]
    assert len(set(got)) == 30 and not set(got) & {f"user{i:03d}@host.example.org" for i in range(30)}
