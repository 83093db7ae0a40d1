"""The operators over whole texts against plain versions, with what matters after the prefixes of the other queries."""

import random
import re

import pytest

from tallgrass.plans import evaluation, registry  # noqa: F401

LONG = "the quick brown fox jumps over the lazy dog and runs on " * 3
TURNS = [LONG + "to the end", LONG + "to an end é", LONG, "short", "", LONG[:100] + "日本", None, "x"]
DOCS = [LONG + "what?!... \n\n next,,  line ;:", LONG, "\n" + LONG, "...!" * 30, LONG + " ) ( ", "", " " * 90]
ITEMS = [LONG, "A" * 150, "abc " * 50, "x, y; z" * 20, "ab", ""]
P = r"[.!,?;:()\[\]{}]"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(TURNS)], "conv_id long, turn int, role string, text string").write.parquet(f"{base}/conversations.parquet")
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_metrics(spark, folder):
    want = {}
    for r, g in zip(TURNS, TURNS[1:]):
        if r is not None and g is not None:
            d, most = distance(r, g), max(len(r), len(g))
            x = want.setdefault("short" if len(r) < 15 else "medium" if len(r) < 30 else "long", [])
            x.append((d, 1 - d / most if most else 1.0, len(r) - d, r.startswith(g) and 0 < len(g) < len(r)))
    got = {r.bucket: r for r in registry.QUERIES["edit_metrics"](spark, folder).filter("distance IS NOT NULL").collect()}
    for bucket, x in want.items():
        r = got[bucket]
        assert (r.distance, r.saved, r.truncated) == tuple(sum(y[k] for y in x) for k in (0, 2, 3))
        assert r.char_accuracy == pytest.approx(sum(y[1] for y in x) / len(x), abs=1e-6)


def test_distance_of_any_texts():
    from tallgrass.operators.metrics import distance as fast

    rnd = random.Random(5)
    for n in (0, 1, 5, 63, 64, 65, 130):
        for _ in range(60):
            a, b = ("".join(rnd.choice("ab日c" if n < 60 else "abcdefgh é") for _ in range(rnd.randrange(n + 1))) for _ in "xy")
            b = rnd.choice([b, a[: n // 2] + b[:9] + a[n // 2 + 5 :]])
            assert fast(a, b) == distance(a, b) == fast(b, a)


def test_filter_suggestion(spark, folder):
    def plain(s):
        r = re.sub(f"({P}){P}+", r"\1", re.sub(r"\s+", " ", re.sub(r"\s+$", "", s)))
        r = re.sub(f"(?: {P}+)+$", "", r)
        return "" if s.startswith("\n") else r if any(c.isalpha() for c in r) or not r.strip() or re.fullmatch(P, r) else ""

    got = {r.doc_id: r.filtered for r in registry.QUERIES["filter_suggestion"](spark, folder).collect()}
    assert got == {i: plain(s) for i, s in enumerate(DOCS)} and len(got[1]) > 150


def test_ghost_suffix(spark, folder):
    def plain(t):
        typed, s, last = t[: len(t) // 2], t[len(t) // 3 :], t[: len(t) // 2][-1:]
        extra = typed[len(t) // 3 :]
        if last and last in text_marks and s[:1] == last:
            s = s[1:]
        hits = [i for i in range(1, min(len(extra), len(s)) + 1) if s[:i].lower() == extra[-i:].lower()]
        return s[max(hits, default=0) :]

    from tallgrass.functions import text

    text_marks = text.PUNCTUATION
    got = {r.item_id: r.ghost for r in registry.QUERIES["ghost_suffix"](spark, folder).collect()}
    assert got == {i: plain(t) for i, t in enumerate(ITEMS)}
