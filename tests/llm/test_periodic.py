"""Periodic runs against every stretch and period of small texts, and the query against its contract."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch of every period, with its smallest period; by definition, with no shortcut."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)  # lags ascend, so the first is the smallest
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    if words and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def texts():
    rnd = random.Random(7)
    for n in list(range(14)) * 4 + [60, 120, 200] * 12:
        words = [rnd.choice("ab" if n < 14 else "abcdefgh") for _ in range(n)]
        for _ in range(rnd.randrange(3)):  # repetitions that overlap, nest and touch the ends
            a = rnd.randrange(n) if n else 0
            p = rnd.randrange(1, 9)
            for i in range(a + p, min(n, a + p * rnd.randrange(2, 9))):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 10)])
def test_scan(exponent, least):
    found = list(texts())
    coded = [[w.encode() for w in words] for words in found]
    assert periodic.scan(*periodic._ids(coded), exponent, least) == [plain_runs(w, exponent, least) for w in found]
    for words, code in zip(found, coded, strict=True):  # ranges of lags find the same together
        least_period = {}
        for k in range(3):
            for s, length, q in periodic.scan(*periodic._ids([code]), exponent, least, k + 1, 3)[0]:
                least_period[s, length] = min(q, least_period.get((s, length), q))
        assert sorted((*k, q) for k, q in least_period.items()) == plain_runs(words, exponent, least)


def test_long_texts_of_few_words():
    same = [b"a"] * 30_000
    assert periodic.scan(*periodic._ids([same, [b"a", b"b"] * 9000]), 4, 6) == [[(0, 30_000, 1)], [(0, 18_000, 2)]]


@pytest.mark.parametrize("range_bytes", [65_536, 100])
def test_query_equals_its_contract(spark, documents, range_bytes, monkeypatch):
    monkeypatch.setattr(periodic.with_runs, "__defaults__", (4, 6, range_bytes))
    got = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [
        "doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"
    ]
    want = [plain_row(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[1] for r in want) and not all(r[1] for r in want)


@pytest.mark.parametrize("range_bytes", [65_536, 16])
def test_odd_rows(odd, nothing, range_bytes):
    more = odd.withColumn("_runs", F.lit("x")).withColumn("_uid", F.lit(3)).withColumn("uid", F.lit(4))
    got = periodic.with_runs(more, range_bytes=range_bytes)
    assert got.columns == [*more.columns, "__runs", "_collapsed"] and got.count() == odd.count()
    for r in got.collect():
        words = WORD.findall(r.text or "")
        assert [tuple(x) for x in r["__runs"]] == ([(0, 24_000, 4)] if len(words) > 9 else [])
        assert r._collapsed == ("alpha beta gamma delta" if len(words) > 9 else " ".join(words))
    assert periodic.with_runs(nothing).count() == 0
    wide = "\u00e9\u00a0x " * 5 + "\u00e9\u00a0x\u2003"  # wide spaces are no white space: five equal words and another
    row = periodic.with_runs(odd.sparkSession.createDataFrame([(1, wide)], "doc_id long, text string"), range_bytes=range_bytes).first()
    assert row._collapsed == wide and row._runs == []
