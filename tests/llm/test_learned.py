"""Learned operators against plain versions: the decision list, nearest-neighbour votes, soft-membership mixing."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import knn, mixing, rules


# --- decision list ---------------------------------------------------------------------------------


def plain_list(rows, grid, max_rules=8, depth=3, precision=0.98):
    """Sequential covering over dictionaries: grow on two thirds, prune on the rest."""
    names, found, left = list(rules.FEATURES), [], rows

    def holds(rule, r):
        return all(r[f] > t if above else r[f] <= t for f, above, t in rule)

    def count(rows_):
        return sum(r["bad"] for r in rows_), sum(1 - r["bad"] for r in rows_)

    for _ in range(max_rules):
        grow, prune = [r for r in left if not r["pruning"]], [r for r in left if r["pruning"]]
        rule, here = [], grow
        for _ in range(depth):
            p0, n0 = count(here)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f in sorted(names):
                for t in grid[f]:
                    for above in (True, False):
                        p, n = count([r for r in here if holds([(f, above, t)], r)])
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0
                        if g > gain:
                            best, gain = (f, above, t), g
            if best is None:
                break
            rule.append(best)
            here = [r for r in here if holds([best], r)]
        if not rule:
            break
        scored = []
        for k in range(len(rule)):
            p, n = count([r for r in prune if holds(rule[: k + 1], r)])
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, rule[: k + 1], p / (p + n) if p + n else 0.0, p + n))
        _, _, rule, sure, covered = max(scored, key=lambda x: x[:2])
        if sure < precision or covered < 3:
            break
        found.append(rule)
        left = [r for r in left if not holds(rule, r)]
    return found


def test_learned_list_against_plain_covering(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(900)]
    docs, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        kind = rnd.randrange(3)
        text = [rnd.choice(words) for _ in range(70)]
        if bad and kind == 0:
            text = [w + "$#" * (rnd.random() < 0.5) for w in text]
        elif bad and kind == 1:
            text = [w.upper() if rnd.random() < 0.6 else w for w in text]
        elif rnd.random() < 0.2:
            text = [w + "!" * (rnd.random() < 0.3) for w in text]
        docs.append((i, " ".join(text)))
        marks.append((i, 0 if bad else 1))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    features = [F.expr(sql).cast("double").alias(name) for name, sql in rules.FEATURES.items()]
    pruning = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("pruning")
    rows = [r.asDict() for r in rules.with_statistics(d).filter(~rules.base_failed()).join(m, "doc_id").select((1 - F.col("quality")).alias("bad"), pruning, *features).collect()]
    cuts = [i / 24 for i in range(1, 24)]
    grid = {}
    for f in rules.FEATURES:
        values = set()
        for bad in (0, 1):
            x = sorted(r[f] for r in rows if r["bad"] == bad)
            values |= {round(x[max(0, math.ceil(q * len(x)) - 1)], 6) for q in cuts}
        grid[f] = sorted(values)
    got = [[(c.feature, c.above, c.threshold) for c in r.conditions] for r in rules.learn(d, m)]
    assert got == plain_list(rows, grid) and len(got) >= 2
    kept = {r.doc_id for r in rules.kept(d, m).collect()}
    by_id = {r["doc_id"]: r.asDict() for r in rules.with_statistics(d).select("doc_id", rules.base_failed().alias("failed"), *features).collect()}
    holds = lambda rule, r: all(r[f] > t if above else r[f] <= t for f, above, t in rule)
    assert kept == {i for i, r in by_id.items() if not r["failed"] and not any(holds(rule, r) for rule in got)}


# --- nearest neighbours ----------------------------------------------------------------------------


def plain_vector(model, text):
    raw = (text or "").encode()
    count = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        count[((a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32 >> 7) % len(model.weight)] += 1
    x = np.zeros(len(model.weight))
    for k, n in count.items():
        x[k] = math.log1p(n) * model.weight[k]
    x /= np.linalg.norm(x) or 1
    v = x @ model.basis
    return v / (np.linalg.norm(v) or 1)


def test_votes_against_all_cosines(spark, documents, labels, odd):
    texts = [r.text for r in documents.orderBy("doc_id").limit(120).collect()] + [r.text for r in odd.collect()]
    model = knn.fit(documents, labels)
    known = labels.select("doc_id", "quality").dropna().collect()
    by_id = dict(documents.select("doc_id", "text").collect())
    vectors = {r.doc_id: plain_vector(model, by_id[r.doc_id]) for r in known if r.doc_id in by_id}
    quality = {r.doc_id: r.quality for r in known}
    assert np.allclose(model.vectors, [vectors[i] for i in sorted(vectors)], atol=2e-4)
    prior = np.mean([quality[i] for i in vectors])
    want = []
    for t in texts:
        v = plain_vector(model, t)
        sims = sorted(((float(v @ u), quality[i]) for i, u in vectors.items()), reverse=True)[: knn.NEIGHBOURS]
        w = [max(s, 0.0) ** knn.SHARPNESS for s, _ in sims]
        want.append(sum(a * y for a, (_, y) in zip(w, sims)) / sum(w) if sum(w) else prior)
    got = model.score(texts)
    close = np.abs(got - want) < 2e-3
    assert close.mean() > 0.97  # equal similarities may let another neighbour in


def test_repeated_ids_do_not_reach_the_driver(spark):
    docs = spark.createDataFrame([(1, f"text number {k}") for k in range(500)] + [(2, "another one"), (3, "and a third")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert len(knn.fit(docs, marks).labels) == 3
    assert knn.scored(docs, marks).count() == 502


# --- mixing ----------------------------------------------------------------------------------------


def plain_rates(texts, model, targets_of, floor=0.0, rounds=60):
    domains, prior, like = model
    rows = []
    for t in texts:
        w = [x for x in (t or "").lower().split() if x]
        hits = Counter(x for x in w if x in like)
        n = sum(hits.values())
        z = [prior[d] + sum(c * like[x][k] for x, c in hits.items()) * min(1.0, 12.0 / max(n, 1)) for k, d in enumerate(domains)]
        e = [math.exp(x - max(z)) for x in z]
        rows.append((len(w), [x / sum(e) for x in e]))
    have = [sum(n * p[k] for n, p in rows) for k in range(len(domains))]
    targets, now, rate = targets_of(have), list(have), [1.0] * len(rows)
    for _ in range(rounds):
        if max(abs(a - b) / b for a, b in zip(now, targets)) < 1e-3:
            break
        error = [(a - b) / h for a, b, h in zip(now, targets, have)]
        rate = [max(floor, r - sum(x * g for x, g in zip(p, error))) for r, (_, p) in zip(rate, rows)]
        now = [sum(r * n * p[k] for r, (n, p) in zip(rate, rows)) for k in range(len(domains))]
    return rows, rate, now, targets


@pytest.mark.parametrize("weights", [None, {"de": 1.0, "en": 1.0, "es": 2.0, "fr": 4.0}])
def test_rates_against_plain_gradient(spark, documents, labels, weights):
    model = mixing.keyword_model(documents, labels)
    ordered = documents.orderBy("doc_id").collect()

    def targets_of(have):
        share = [weights[d] for d in model[0]] if weights else [x**mixing.ALPHA for x in have]
        share = [x / sum(share) for x in share]
        return [max(h / s for h, s in zip(have, share)) * s for s in share]

    rows, rate, now, targets = plain_rates([r.text for r in ordered], model, targets_of)
    assert max(abs(a - b) / b for a, b in zip(now, targets)) < 1e-3
    rated, domains = mixing.mixed(documents, labels, weights)
    got = rated.orderBy("doc_id").collect()
    assert domains == model[0] and len(got) == len(ordered)
    for r, (n, p), want in zip(got, rows, rate):
        assert r["_n"] == n and np.allclose(r["_p"], p, atol=1e-9) and r["_rate"] == pytest.approx(want, abs=1e-6)


def test_every_labelled_domain_counts(spark):
    docs = spark.createDataFrame([(i, f"word{i % 80} text of domain{i % 80}", f"d{i % 80:02}") for i in range(240)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(240)], "doc_id long, quality int")
    assert len(mixing.keyword_model(docs, marks)[0]) == 80


def test_targets_out_of_reach_are_told(spark):
    slim = spark.createDataFrame([([0.5, 0.5], 10), ([0.5, 0.5], 20)], "_p array<double>, _n long")
    with pytest.warns(UserWarning, match="from its target"):
        mixing.fit_rates(slim, [30.0, 10.0], rounds=3)


# --- clashing names --------------------------------------------------------------------------------


def test_columns_of_added_names_pass_through(spark, labels):
    row = [(k, "alpha beta gamma delta " * 20 + str(k), "en", "n", "p", "m", "r", "w", "k", "b") for k in range(6)]
    names = ["doc_id", "text", "lang", "_n", "_p", "_m", "_rate", "_n_words", "_kept", "_copy"]
    df = spark.createDataFrame(row, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = rules.judged(df, labels)
    assert [r["_n_words"] for r in got.collect()] == ["w"] * 6 and [r["__n_words"] for r in got.collect()] == [81] * 6 and got.filter("_kept = 'k' AND __kept IS NOT NULL").count() == 6
    assert rules.kept(df, labels.limit(0)).columns == names
    rated, _ = mixing.mixed(df, labels)
    assert rated.columns[: len(names)] == names and rated.filter("_n = 'n' AND __n = 81").count() == 6
    assert mixing.taken(df, labels).columns == names
