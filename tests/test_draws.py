"""Seeded draws against the generators themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import draws, metrics


def test_shuffle(spark):
    rows = [(k * 37 % 1000, f"s{k}") for k in range(700)] + [(None, "none"), (5, "s5 again")]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    random.Random(42).shuffle(want)
    got = draws.shuffled(df, ["k", "v"], 42).orderBy("place").collect()
    assert [(r.k, r.v) for r in got] == want and [r.place for r in got] == list(range(len(rows)))
    assert [(r.k, r.v) for r in draws.first_shuffled(df, ["k", "v"], 42, 9).orderBy("place").collect()] == want[:9]
    assert draws.shuffled(df.limit(0), ["k"], 1).count() == 0
    with pytest.raises(ValueError, match="seeded"):
        draws.shuffled(df, ["k"], 1, most=10)


@pytest.mark.parametrize("n", [1, 2, 333])
def test_bootstrap_interval(spark, n):
    rnd = np.random.RandomState(n)
    values = [float(x) for x in rnd.rand(n).round(2)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(n + 5, None)], "k int, v double").repartition(3)
    drawn = np.random.RandomState(42)
    means = [drawn.choice(np.array(values), size=n, replace=True).mean() for _ in range(200)]
    got = draws.bootstrap_interval(df, "v", ["k"], 200).first()
    assert tuple(got) == (pytest.approx(np.mean(values)), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)), n)
    assert tuple(draws.bootstrap_interval(df.filter("v > 9"), "v", ["k"], 10).first()) == (0.0, 0.0, 0.0, 0)


def test_bootstrap_by_blocks(spark):
    """Values in several blocks give the interval of the generator's own resamples."""
    values = np.random.RandomState(9).rand(250).round(3)
    drawn = np.random.RandomState(7)
    means = [drawn.choice(values, size=250, replace=True).mean() for _ in range(50)]
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").repartition(3)
    got = draws.bootstrap_interval(df, "v", ["k"], 50, 0.9, 7, block=64).first()
    assert tuple(got) == (pytest.approx(values.mean()), pytest.approx(np.percentile(means, 5)), pytest.approx(np.percentile(means, 95)), 250)


def test_split_points(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.choice(["▁a", "b", "cc"]) for _ in range(rnd.randrange(25))]) for k in range(300)] + [(900, None), (None, ["▁a"] * 9), (901, ["b"] * 9), (902, ["▁a"] * 5)]
    got = {r.k: (r.s.p1, r.s.p2) for r in spark.createDataFrame(rows, "k long, p array<string>").withColumn("s", draws.split_points(F.col("p"), F.col("k"))).collect()}

    def plain(seed, row):
        n, r = len(row or []), random.Random(seed)
        if n < 5 or seed is None:
            return None, None
        words = sorted(set([0] + [i for i in range(n) if row[i].startswith("▁")] + [n]))
        if r.random() < 0.2 and len(words) >= 3:
            for _ in range(10):
                i = r.randint(0, len(words) - 2)
                j = r.randint(i + 1, len(words) - 1)
                if words[j] - words[i] >= 3:
                    return words[i], words[j]
        first = r.randint(0, n - 3)
        return first, r.randint(first + 3, n)

    assert got == {k: plain(k, p) for k, p in rows}


def test_quantiles(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([0.25, 3.0, rnd.random() * 50, -rnd.random() * 9])) for g in ("a", "b", None) for _ in range(rnd.randrange(1, 200))] + [("c", None), ("d", 7.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in metrics.summary_of(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in ("a", "b", None, "d"):
        v = [x for k, x in rows if k == g]
        assert (got[g].p50, got[g].p95, got[g].lo, got[g].n) == (pytest.approx(np.percentile(v, 50)), pytest.approx(np.percentile(v, 95)), min(v), len(v))
    assert got["c"].n == 0 and got["c"].p50 is None


def test_binomial(spark):
    import math

    rows = [(k, n) for n in (0, 1, 7, 20, 61) for k in range(n + 1)]
    p = lambda n, k: math.comb(n, k) / 2**n
    for r in spark.createDataFrame(rows, "k int, n int").withColumn("p", metrics.binomial_test(F.col("k"), F.col("n"))).collect():
        assert r.p == pytest.approx(min(1.0, sum(p(r.n, j) for j in range(r.n + 1) if p(r.n, j) <= p(r.n, r.k) * (1 + 1e-9))))
