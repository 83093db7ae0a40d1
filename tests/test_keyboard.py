"""The keyboard, its simulation and replay, and what else SQL can't follow, on small cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import suggestion, text
from tallgrass.operators import keyboard, metrics, telemetry, tokens, unigram
from tallgrass.plans import keyboard as _keyboard, preparation, registry  # noqa: F401

OFFERS = {
    ("a", ""): [("big", 0.5, False), ("cat", 0.3, False), ("dog", 0.2, False), ("owl", 0.1, False)],
    ("big", ""): [("dog", 0.6, False)], ("a", "c"): [("cat", 0.4, False)], ("big", "c"): [("cow", 0.2, False)], ("cow", ""): [("eats", 0.9, False)], ("big", "co"): [("cow", 0.2, False), ("eats", 0.15, True)],
}


def offers(prev, typed):
    return OFFERS.get((prev, typed), [])


def test_typing_taps_shown_words_and_types_the_rest():
    t = keyboard.Typist(offers, "a ")
    for w in "big cow eats.".split():
        t.word(w)
    r = t.result("big cow eats.")
    kinds = [e["type"] for e in t.events]
    assert [c[:2] for c in r["completed"]] == [("big", "completion"), ("cow", "completion"), ("eats", "completion")]
    assert r["keystrokes"] == 4 and r["taps"] == 3 and kinds.count("keystroke") == 1 and kinds.count("check") == 4
    assert r["csr"] == round((13 - 4) / 13, 4) and r["avg_prefix"] == round(1 / 3, 2) and r["top1"] == 1.0 and t.text == "a big cow eats "
    assert keyboard._replay(["big", "cow", "eats."], t.events) == (3, 3, 3, 3, ["completion"] * 3)


def test_words_that_no_chip_offers_are_typed():
    t = keyboard.Typist(offers, "a")
    for w in "zoo zoo".split():
        t.word(w)
    r = t.result("zoo zoo")
    assert r["keystrokes"] == 8 and r["taps"] == 0 and r["csr"] < 0 and [c[1] for c in r["completed"]] == ["manual"] * 2 and t.text == "a zoo zoo"
    assert keyboard._replay(["zoo", "zoo"], t.events) == (0, 0, 0, 2, ["manual"] * 2)


def test_pools_stick_while_the_word_still_begins_so():
    t = keyboard.Typist(offers, "a ")
    t.word("dot")
    first, second = [[c["text"] for c in e["displayed"]] for e in t.events if e["type"] == "check"][:2]
    assert first == ["big", "cat", "dog"] and second == ["dog"]


def test_random_traces_replay_to_the_same_counts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(30)]
    for _ in range(60):
        table = {}
        look = lambda prev, typed: table.setdefault((prev, typed), [(w, rnd.random(), False) for w in rnd.sample(vocabulary, 4) if w.startswith(typed)])  # noqa: E731, B023
        t, words = keyboard.Typist(look, "x "), rnd.choices(vocabulary, k=6)
        for w in words:
            t.word(w)
        top1, top3, top5, n, methods = keyboard._replay(words, t.events)
        assert (top1, top3, top5, n) == (t.hits[1], t.hits[3], t.hits[5], 6)
        assert methods == ["manual" if m == "manual" else "completion" for _, m, _ in t.completed]


def test_simulation_over_tables(spark):
    tests = spark.createDataFrame([(1, "a", "big cow eats"), (2, "zz", ""), (3, None, "q")], "test_id int, prompt string, target string")
    followers = spark.createDataFrame([("a", "big", 0.9), ("big", "cow", 0.8), ("cow", "eats", 0.7)], "prev string, word string, prob double")
    found = keyboard.keyboard_candidates(keyboard.contexts_of(tests.na.fill("")), followers)
    got = {r.test_id: r for r in keyboard.simulate(tests, found).collect()}
    assert got[1].taps == 3 and got[1].keystrokes == 3 and [c.method for c in got[1].completed] == ["next_word", "completion", "completion"]
    assert got[2].n_words == 0 and got[3].keystrokes == 1
    all_ = {r["set"]: r for r in keyboard.summary(keyboard.simulate(tests, found).withColumn("set", F.lit("s")), "set").collect()}
    assert all_["all"].tests == 3 and all_["s"].completion + all_["s"].next_word == 3 and all_["s"].manual == 1


def test_suggestion_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(suggestion.decoded(F.lit(b"a\xff"))) == "a�"
    assert one(suggestion.clean_chunk(F.lit("▁a�b"))) == " ab"
    prompts = {'"text"': "text", "[1, 2]": "1 2", '["x", "y"]': "x", "{}": "", "[]": ""}
    for raw, want in prompts.items():
        assert one(suggestion.normal_prompt(F.parse_json(F.lit(raw)))) == want, raw
    path = F.array(*[F.struct(F.lit(t).alias("text"), F.array(*map(F.lit, o)).alias("others")) for t, o in (("a", ["b"]), ("1", ["2", "c"]), ("3", ["4"]), ("d", ["e"]))])
    assert tuple(one(suggestion.repaired(path))) == (["a", "c"], 1)
    blank = F.array(F.struct(F.lit(" ").alias("text"), F.array(F.lit("ok")).alias("others")))
    assert tuple(one(suggestion.repaired(blank))) == (["ok"], 0)
    assert one(text.strip_tags(F.lit("a &eacute; &lt;b&gt; c"), whole_table=True)) == "a é  c"
    assert one(text.has_digit_run(F.lit("x1234567"))) and not one(text.has_digit_run(F.lit("x1234567"), 0))
    line = F.lit("aa. Bb bb. Cc cc. Dd")
    assert one(text.split_boundaries(line)) == ["aa.", "Bb bb.", "Cc cc.", "Dd"]
    assert one(text.split_boundaries(F.lit("aa. Bb bb. Cc"), mis_stitched=True)) == ["aa. Bb bb", ".", "Cc"]


def test_second_cleaner_and_its_toggles(spark):
    star = "★"
    rows = [(f"so {star * 5} much of it here",), ("so \U0001f600\U0001f600\U0001f600\U0001f600 much of it here",), ("see http://x.y now &lt;b&gt; ok",)]
    df = spark.createDataFrame(rows, "x string")
    got = [r.y for r in df.select(text.phase2_prefix(F.col("x")).alias("y")).collect()]
    assert got == [f"so {star * 2} much of it here", rows[1][0], "see now ok"]
    off = text.Cleaning(urls=False, tags=False, emoji=False)
    assert [r.y for r in df.select(text.phase2_prefix(F.col("x"), off).alias("y")).collect()] == [r[0] for r in rows]


def test_segmentation_against_all_splits(spark):
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.5), ("b", -1.7), ("ab", -2.0), ("▁a", -2.2), ("ba", -2.4), ("▁ab", -4.0), ("bab", -3.0)]
    score = dict(vocabulary[1:])
    model = unigram.Vocabulary(vocabulary)

    def best(word):
        if not word:
            return 0.0
        return max((score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in score), default=-math.inf)

    words = ["ab", "babab", "a", "bba", "aabb", "abab"]
    df = spark.createDataFrame([(w,) for w in words], "line string")
    for r in unigram.encoded(df, model).collect():
        pieces = [vocabulary[i][0] for i in r.ids]
        assert "".join(pieces) == "▁" + r.line and sum(score[p] for p in pieces) == pytest.approx(best("▁" + r.line))


def test_piece_splits(spark):
    lines = spark.createDataFrame([(i, 0, [f"▁w{k}" if k % 3 == 0 else f"p{k}" for k in range(12)]) for i in range(400)] + [(999, 0, ["▁a", "b"])], "doc_id long, line_no int, pieces array<string>")
    got = tokens.piece_splits(lines).collect()
    assert len(got) == 400 and all(0 <= r.p1 and r.p1 + 2 <= r.p2 <= 12 for r in got)
    on = [r for r in got if r.on_boundary]
    assert 40 < len(on) < 120 and all(r.p1 % 3 == 0 and r.p2 % 3 == 0 for r in on)


def test_batches_of_a_client(spark):
    times = [0, 1, 4.9, 5, 6, 20] + [30] * 45
    rows = [(1, i, float(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "session_id long, id long, t double").withColumn("timestamp", F.timestamp_seconds("t"))
    sizes = [r["count"] for r in telemetry.flushed(df).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [3, 2, 1, 20, 20, 5]


def test_bootstrap_interval(spark):
    rnd = random.Random(4)
    values = [rnd.gauss(10, 2) for _ in range(300)]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 5.0), ("same", 2.0), ("same", 2.0)], "g string, v double")
    got = {r.g: r for r in metrics.bootstrap_mean(df, "v", "g", 400).collect()}
    mean, half = sum(values) / 300, 1.96 * 2 / math.sqrt(300)
    assert got["g"].mean == pytest.approx(mean) and abs(got["g"].lo - (mean - half)) < 0.08 and abs(got["g"].hi - (mean + half)) < 0.08
    assert (got["same"].lo, got["same"].hi, got["same"].n) == (2.0, 2.0, 2) and got["one"].lo == 5.0


def test_registered_replay_agrees_with_the_simulation(spark):
    rows = registry.QUERIES["retroactive_topk"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all((r.top1, r.top3, r.top5) == (r.stored_top1, r.stored_top3, r.stored_top5) and r.same_words for r in rows)
