"""The typing simulation against a plain loop."""

import random

import pytest

from tallgrass.operators import simulation


def typed(prompt, target, guesses, order, most):
    done, steps = 0, []
    while done < len(target) and len(steps) < most:
        text = f"{prompt} {target[:done]}" if done or order is not None else prompt
        asked = text if order is None else " ".join(text.split(" ")[-order - 1 :])
        guess, rest = guesses.get(asked, "").lstrip(" "), target[done:]
        n = 0
        while n < min(len(guess), len(rest)) and guess[n] == rest[n]:
            n += 1
        done += max(n, 1)
        steps.append((asked, guess, n, target[:done]))
    return steps


@pytest.mark.parametrize(("order", "most"), [(None, 120), (1, 120), (2, 5)])
def test_against_a_loop(spark, order, most):
    rnd = random.Random(order or 0)
    text = lambda n: " ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    tests = [(k, text(rnd.randrange(1, 4)), text(rnd.randrange(1, 7))) for k in range(60)] + [(90, None, "ab"), (91, "a", None), (92, "a", ""), (93, "a b", "b é😀x"), (0, "zz", "a")]
    contexts = {s[0] for k, p, t in tests for s in typed(p or "", t or "", {}, order, 999)}
    rows = [(c, rnd.choice([text(1), text(2), " " + text(1), "", None])) for c in sorted(contexts) if rnd.random() < 0.8]
    rows += rows[:40] + [(c, "b") for c, _ in rows[:40]] + [(None, "a")]  # repeated contexts: the least guess counts
    known = {}
    for c, g in rows:
        if g is not None:
            known[c] = min(g, known.get(c, g))
    a = spark.createDataFrame(tests, "test_id int, prompt string, target string")
    b = spark.createDataFrame(rows, "context string, guess string")
    want, trace = [], []
    for k, p, t in tests:
        steps = typed(p or "", t or "", known, order, most)
        auto = sum(s[2] for s in steps)
        want.append((k, len(steps), sum(s[2] > 0 for s in steps), len(steps[-1][3]) if steps else 0, auto, 1 - len(steps) / len(t) if t else None))
        trace += [(k, i + 1, *s) for i, s in enumerate(steps)]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = simulation.simulate_csr(a, b, order=order, most=most).collect()
    assert sorted(map(key, got), key=str) == [tuple((x, pytest.approx(y)) if x else (x, y) for x, y in r) for r in sorted(map(key, want), key=str)]
    assert any(r.accepted > 1 for r in got)
    shown = [(r.test_id, r.step, r.context, r.guess, r.matched, r.typed) for r in simulation.simulate_csr(a, b, order=order, most=most, steps=True).collect()]
    assert sorted(shown) == sorted(trace)


def test_no_rows(spark):
    a = spark.createDataFrame([], "test_id int, prompt string, target string")
    b = spark.createDataFrame([], "context string, guess string")
    assert simulation.simulate_csr(a, b).count() == 0
    one = spark.createDataFrame([(1, "a", "bcd")], "test_id int, prompt string, target string")
    assert tuple(simulation.simulate_csr(one, b).first()) == (1, 3, 0, 3, 0, 0.0)


def test_next_word_savings(spark):
    from collections import Counter

    from tallgrass.operators import metrics

    rnd = random.Random(4)
    pairs = [(rnd.choice("xyz"), "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5)))) for _ in range(400)] + [("x", "é😀")]
    counts = Counter(pairs)

    def first(prev, word):
        for k in range(len(word) + 1):
            if word == min((w for p, w in counts if p == prev and w.startswith(word[:k])), key=lambda w: (-counts[prev, w], w)):
                return k

    found = {(p, w): first(p, w) for p, w in counts}
    df = spark.createDataFrame(pairs, "prev string, word string")
    assert {(r.prev, r.word): r.typed for r in metrics.first_prefixes(df).collect()} == {k: v for k, v in found.items() if v is not None}
    for r in metrics.next_word_csr(df, "prev").collect():
        own = [(w, found[p, w]) for p, w in pairs if p == r.prev]
        keys = sum(1 + (len(w) if k is None else k + 1) for w, k in own)
        chars = sum(len(w) + 1 for w, _ in own)
        assert (r.n, r.accepted, r.keystrokes, r.chars, r.csr) == (len(own), sum(k is not None for _, k in own), keys, chars, round(1 - keys / chars, 6))


def test_a_longer_target_takes_no_more_jobs(spark):
    """Work is a join of words, not one of all open tests for each keystroke."""
    known = spark.createDataFrame([("a x", "xx")], "context string, guess string")

    def jobs(n):
        group = f"typing {n}"
        spark.sparkContext.setJobGroup(group, group)
        one = spark.createDataFrame([(1, "a", "x" * n)], "test_id int, prompt string, target string")
        assert simulation.simulate_csr(one, known, order=1).first().typed == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(6), jobs(60)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 1
