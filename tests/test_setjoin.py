"""Containment against all pairs."""

import random

import pytest

from tallgrass.operators import setjoin


def plain(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize(("num", "den", "size"), [(4, 5, 5), (1, 2, 2), (1, 1, 3)])
def test_against_all_pairs(spark, num, den, size):
    rnd = random.Random(size)
    word = lambda: rnd.choice("abcdefghijklmnopqrst") * rnd.choice([1, 2])
    passage = [word() for _ in range(30)]
    queries = [(k, " ".join(passage[: rnd.randrange(30)] + [word() for _ in range(rnd.randrange(25))])) for k in range(25)] + [(90, None), (91, "  "), (92, "a"), (93, "Aa b")]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rnd.randrange(40))]
        if rnd.random() < 0.7:  # a copy with some words changed
            copy = (rnd.choice(queries)[1] or "").split()
            for _ in range(rnd.randrange(4)):
                if copy:
                    copy[rnd.randrange(len(copy))] = word()
            own[len(own) // 2 : len(own) // 2] = copy
        docs.append((k, " ".join(own).upper() if k % 2 else " ".join(own)))
    docs += [(500, None), (501, ""), (3, " ".join(passage))]
    sets, held = {q: plain(t, size) for q, t in queries}, {}
    for d, t in docs:
        held.setdefault(d, set()).update(plain(t, size))
    want = sorted((d, q, len(s & h), len(s)) for d, h in held.items() for q, s in sets.items() if s and den * len(s & h) >= num * len(s))
    q = spark.createDataFrame(queries, "query long, text string")
    c = spark.createDataFrame(docs, "id long, text string")
    assert sorted(map(tuple, setjoin.contained(q, c, num, den, size).collect())) == want and len(want) > 20
    assert setjoin.contained(q.limit(0), c).count() == 0 == setjoin.contained(q, c.limit(0)).count()
