"""The token stream of a corpus against plain folds, and its array file against numpy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import stream
from tallgrass.sources import npy


def examples(seed, n, longest):
    rnd = random.Random(seed)
    return [(k // 7, k % 7, [rnd.randrange(5, 4000) for _ in range(rnd.choice([1, 2, rnd.randrange(longest), longest]))] + [2]) for k in range(n)]


def fold(rows, room):
    """Window starts, lengths, examples and cuts, example by example."""
    out, at, used = [], 0, 0
    for _, _, ids in rows:
        n = len(ids)
        if n > room:
            out.append([at, 1, room, True, ids[:room]])
            used = 0
        elif used and used + n <= room:
            out[-1] = [out[-1][0], out[-1][1] + 1, used + n, False, out[-1][4] + ids]
            used += n
        else:
            out.append([at, 1, n, False, ids])
            used = n
        at += n
    return out


@pytest.fixture(scope="module")
def made(spark):
    def make(rows):
        return stream.token_stream(spark.createDataFrame(rows, "doc_id int, line_no int, ids array<int>").repartition(5), ["doc_id", "line_no"])

    return make


@pytest.mark.parametrize(("n", "longest", "room", "block", "fan"), [(200, 30, 33, 16, 3), (300, 60, 40, 1, 4), (50, 5, 1, 7, 2), (120, 300, 128, 65_536, 64), (1, 9, 4, 8, 2)])
def test_packing_equals_a_fold(made, n, longest, room, block, fan):
    rows = examples(n, n, longest)
    got = stream.packed_windows(made(rows), room, pad=0, block=block, fan=fan).orderBy("window_start").collect()
    want = fold(rows, room)
    assert [[r.window_start, r.examples, r.length, r.truncated] for r in got] == [w[:4] for w in want]
    for r, w in zip(got, want, strict=True):
        full = w[4] + [0] * (room - len(w[4]))
        assert (r.x, r.y) == (full[:-1], full[1:])


@pytest.mark.parametrize(("n", "window"), [(150, 64), (90, 1), (3, 1000)])
def test_windows_equal_slices(made, n, window):
    rows = examples(n, n, 90)
    flat = [i for r in rows for i in r[2]]
    got = stream.windows(made(rows), window).orderBy("window_no").collect()
    assert [(r.window_no, r.x, r.y) for r in got] == [(k, flat[k * window : (k + 1) * window], flat[k * window + 1 : (k + 1) * window + 1]) for k in range((len(flat) - 1) // window)]


def test_odd_rows(spark, made):
    none = made([])
    assert stream.windows(none, 8).count() == 0 == stream.packed_windows(none, 8).count() == stream.tokens_of(none)
    odd = made([(1, 0, None), (1, 1, []), (1, 1, [7, 2]), (None, 0, [8, 2]), (1, 2, [2])])
    assert [(r.start, r.n) for r in odd.orderBy("number").collect()][0] == (0, 2) and stream.tokens_of(odd) == 5
    assert [r.x for r in stream.windows(odd, 4).collect()] == [[8, 2, 7, 2]]
    assert [(r.window_start, r.length) for r in stream.packed_windows(odd, 3).orderBy("window_start").collect()] == [(0, 2), (2, 3)]


def test_array_round_trip(spark, made, tmp_path):
    rows = examples(1, 400, 50) + [(999, 0, [0, 65535])]
    flat = [i for r in rows for i in r[2]]
    s, path = made(rows), f"{tmp_path}/tokens.npy"
    npy.write_array(s, f"file://{path}", stream.tokens_of(s))
    found = np.load(path, mmap_mode="r")
    assert found.dtype == np.uint16 and found.tolist() == flat and os.listdir(tmp_path) == ["tokens.npy"]
    back = npy.read_array(spark, path, rows=100, splitIds=1000).orderBy("start").collect()
    assert [i for r in back for i in r.ids] == flat and [r.start for r in back] == list(range(0, len(flat), 100))
    for window in (64, len(flat) - 1, len(flat)):
        cut = npy.read_array(spark, path, window=window, splitIds=500).orderBy("start").collect()
        assert [(r.start, r.ids) for r in cut] == [(k * window, flat[k * window : (k + 1) * window + 1]) for k in range((len(flat) - 1) // window)]
    npy.write_array(s.limit(0), path, 0)
    assert np.load(path).tolist() == [] == npy.read_array(spark, path).collect()


def test_a_failed_write_leaves_nothing(spark, made, tmp_path):
    path = f"{tmp_path}/tokens.npy"
    s = made(examples(2, 60, 20))
    n = stream.tokens_of(s)
    for bad, length in ((s, n + 1), (s, n - 1), (s.filter("number <> 7"), n), (s.unionByName(s.filter("number = 3")), n), (s.withColumn("ids", F.expr("if(number = 9, array(65536), ids)")), n), (s.withColumn("ids", F.expr("if(number = 9, array(-1), ids)")), n)):
        with pytest.raises(Exception):
            npy.write_array(bad, path, length)
        assert os.listdir(tmp_path) == []
    npy.write_array(s, path, n)
    spark.dataSource.register(npy.TokenArray)
    with pytest.raises(Exception):
        s.select("start", "ids").write.format("token_array").option("length", n).mode("append").save(path)
    assert os.listdir(tmp_path) == ["tokens.npy"] and len(np.load(path)) == n
    np.save(path, np.zeros((2, 2)))
    with pytest.raises(Exception):
        npy.read_array(spark, path).collect()
    with pytest.raises(Exception):
        npy.write_array(s, "s3://bucket/tokens.npy", n)
