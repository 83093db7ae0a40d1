"""The pipeline's near-duplicate stage against brute-force Jaccard, with planted near copies."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tallgrass.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(docs):
    """The smallest id of each component of pairs with similarity 0.8 or more."""
    sets, root = [plain_sets(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted(least.values())


def plain_parts(keys, prints, radius):
    """The least lane that each reaches over lanes of its bucket that differ in at most ``radius`` bits."""
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in np.flatnonzero(keys[:i] == keys[i]):
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_bit_planes_find_the_parts_of_buckets():
    """Short and long buckets, with lanes of up to 90 of 192 bits from a common one, against a count of bits."""
    rnd = np.random.default_rng(3)
    keys = np.repeat(np.arange(9), [1, 2, 40, 70, 3, 200, 128, 129, 1])
    prints = rnd.integers(0, 1 << 64, (len(keys), 3), dtype=np.uint64)
    for i in range(0, len(keys), 3):
        prints[i] = prints[3 * (i % 7)]
        for b in rnd.choice(192, rnd.integers(0, 91), replace=False):
            prints[i, b // 64] ^= np.uint64(1 << int(b % 64))
    got = similar.parts_of(keys, prints)
    assert got.tolist() == plain_parts(keys, prints, similar.RADIUS) and len(set(got.tolist())) < len(keys)
    for radius in (0, 1, 62, 95, 192):
        differ = similar.planes_of(prints) ^ similar.planes_of(prints[::-1])
        near = np.unpackbits(similar.within(differ, radius).view(np.uint8), bitorder="little")[: len(keys)]
        assert (near == (np.bitwise_count(prints ^ prints[::-1]).sum(axis=1) <= radius)).all()


@pytest.mark.parametrize("bits", [12, 15])
def test_sets_at_the_similarity_share_a_table_and_the_radius(bits):
    """Pairs of 0.8 exactly or nearly so, of the sizes at which bits differ most and of large ones."""
    rnd = np.random.default_rng(bits)
    new = lambda n: rnd.integers(0, 1 << 64, n, dtype=np.uint64)
    for both, one, other in [(4, 1, 0), (5, 1, 0), (12, 3, 0), (12, 2, 1), (20, 3, 2), (80, 10, 10), (400, 100, 0)] * 12:
        common = new(both)
        a, b = (np.unique(np.r_[common, new(n)]) for n in (one, other))
        assert similar.similar(a, b)
        (x, i), (y, j) = similar.fingerprint(a, bits), similar.fingerprint(b, bits)
        shared = set(i) & set(j)
        assert shared and (min(shared) < 0 or np.bitwise_count(x ^ y).sum() <= similar.RADIUS)
        assert len(i) == len(set(i)) and sum(k >= 0 for k in i) == similar.tables_of(bits)


def test_stage_compares_by_bit_planes(spark):
    """A pair meets in a part, whatever number of tables finds it, and nothing meets without a part."""
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q r s t u v w x"), (4, None)]
    rows = similar.with_row_key(spark.createDataFrame(docs, "doc_id long, text string"))
    found = similar.marked_sets(rows, 12).collect()
    of = {r.doc_id: r.fp for r in found}
    sets = spark.createDataFrame([(r.fp, r.prints, r["keys"]) for r in found], "fp long, prints array<long>, keys array<long>")
    parts = similar.near_parts(sets).collect()
    assert {r.fp for r in parts} == {of[1], of[2]} and {(r.least, r.c) for r in parts} == {(min(of[1], of[2]), 2)} and len(parts) == 2


@pytest.mark.parametrize("block", [3, 4096])
def test_buckets_of_mixed_components(spark, block):
    """Texts that share a long passage meet in buckets without being similar, beside chains and near copies of them."""
    rnd = random.Random(block)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, docs = [word() for _ in range(90)], []
    for k in range(40):
        own = [word() for _ in range(rnd.choice([12, 40, 90]))]
        for c in range(rnd.choice([1, 1, 3])):
            copy = list(own)
            copy[rnd.randrange(len(copy))] = word()
            docs.append((100 * k + c, " ".join(passage + copy)))
    chain = passage + [word() for _ in range(20)]
    for k in range(25):
        chain[rnd.randrange(len(chain))] = word()
        docs.append((9000 + k, " ".join(chain)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked, firsts, roots = similar.components(df, block)
    kept = sorted(r.doc_id for r in similar.representatives(marked, firsts, roots).collect())
    assert kept == plain_kept(docs) and len(kept) < len(docs)


def test_stage_against_brute_force_with_planted_copies(spark, documents, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    for n in (30, 60, 150, 400, 1500):
        for share in (0.0, 0.005, 0.01, 0.02, 0.022, 0.03, 0.08):
            text = [word() for _ in range(n)]
            copy = list(text)
            for at in rnd.sample(range(n), max(1, int(n * share))):
                copy[at] = word()
            docs += [(10_000 + len(docs), " ".join(text)), (20_000 + len(docs), " ".join(copy))]
    chain = [word() for _ in range(300)]  # each step is near the one before, the ends are not near each other
    for k in range(12):
        chain[k * 20] = chain[k * 20 + 10] = word()
        docs.append((30_000 + k, " ".join(chain)))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert got.columns == ["doc_id", "text"]
    assert sorted(r[0] for r in got.select("doc_id").collect()) == plain_kept(docs)


def test_stage_on_odd_rows(spark, odd, nothing, tmp_path):
    got = corpus_pipeline.near_dedup(spark, odd, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and 8 in ids and 9 not in ids
    assert corpus_pipeline.near_dedup(spark, nothing, str(tmp_path)).count() == 0


def near_group(rnd, copies, words=150, changed=3):
    """Texts of one passage with some words of a small vocabulary put in: most pairs fall short of 0.8."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, some, docs = [word() for _ in range(words)], [word() for _ in range(2)], []
    for k in range(copies):
        copy = list(passage)
        for at in rnd.sample(range(words), changed):
            copy[at] = rnd.choice(some)
        docs.append((k, " ".join(copy)))
    return docs


def test_pairs_with_leasts_are_no_more_than_sets(spark, monkeypatch):
    """Each table that finds a set names another least one; a set is compared with one of them, not with all."""
    docs, seen, real = near_group(random.Random(5), 120), [], similar.star_links

    def star_links(members, sets):
        seen.append(members.filter("fp <> least").select("fp", "least").distinct().count())
        return real(members, sets)

    monkeypatch.setattr(similar, "star_links", star_links)
    kept = similar.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect()
    assert 0 < seen[0] <= len({t for _, t in docs}) and sorted(r[0] for r in kept) == plain_kept(docs)


def test_shared_shingles_and_the_bound_that_they_give(spark):
    """Counts against sets, with copies and odd texts; sets mostly of their own shingles are in no part, whatever their bits."""
    docs = near_group(random.Random(6), 30) + near_group(random.Random(7), 30, changed=6)
    docs = [(i, t) for i, (_, t) in enumerate(docs * 2)] + [(900, None), (901, " "), (902, "a b"), (903, "A b"), (904, "a b c d e f")]
    rows = similar.with_row_key(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    sets = {}
    for _, t in docs:
        s = similar.shingles(t)
        sets[similar.set_key(s)] = set(s.tolist())
    count = {}
    for s in sets.values():
        for h in s:
            count[h] = count.get(h, 0) + 1
    wanted = {fp: n for fp, s in sets.items() if (n := sum(count[h] > 1 for h in s))}
    for buckets in (1, 7):
        assert {r.fp: r.shared for r in similar.shared_shingles(rows, buckets).collect()} == wanted
    n, shared = np.array([100, 100, 85, 100]), np.array([100, 85, 85, 79])
    pairs = {(i, j) for i in range(4) for j in range(i) if similar.possible(n[i : i + 1], shared[i : i + 1], n[j], shared[j])[0]}
    assert pairs == {(2, 0), (2, 1)}
    for many in (1, 60):  # short and long buckets
        label = similar.parts_of(np.zeros(4 * many, np.int64), np.zeros((4 * many, 3), np.uint64), np.repeat(n, many), np.repeat(shared, many))
        assert (label[: 3 * many] == 0).all() and label[3 * many :].tolist() == list(range(3 * many, 4 * many))
