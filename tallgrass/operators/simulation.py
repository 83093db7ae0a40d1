"""Typing simulated keystroke by keystroke: each step asks for a prediction of what has been typed so far.

What a step may ask for is known before the walk: the text up to each place of the target. So all
predictions of a test are met in one join, a word at a time, and the test is then walked where its row is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.sources.shared import staged


def context(typed: Column, order: int | None) -> Column:
    """What a prediction is asked for: the whole text, or its last ``order`` words and the word begun after them."""
    if order is None:
        return typed
    parts = F.split(typed, " ")
    return text.let(parts, lambda p: F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - order), F.lit(order + 1)), " "))


def completions(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``context, guess`` for the wanted contexts (a word, a space, and the word begun): the rest of the
    most frequent follower that goes on from there, ties by spelling, and that word's own
    most frequent follower. A follower's beginnings are met with the wanted contexts by key
    and combine map-side, so a word of many followers gathers nothing in one row."""
    counts = pairs.groupBy("prev", "word").agg(F.count("*").alias("n"))
    best = F.min_by("word", F.struct((-F.col("n")).alias("n"), F.col("word")))
    top = counts.groupBy(F.col("prev").alias("word")).agg(best.alias("after"))
    begun = counts.select("prev", "word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("k"))
    begun = begun.select(F.concat_ws(" ", "prev", F.left("word", F.col("k"))).alias("context"), "word", "n", "k").join(wanted.select("context").distinct(), "context", "left_semi")
    found = begun.groupBy("context").agg(best.alias("word"), F.first("k").alias("k"))
    return found.join(top, "word", "left").select("context", F.concat_ws(" ", F.expr("substr(word, k + 1)"), "after").alias("guess"))


def simulate_csr(tests: DataFrame, predictions: DataFrame, order: int | None = None, most: int = 120, steps: bool = False) -> DataFrame:
    """The greedy typing simulation: at each step the prediction for the text so far (the prompt, a space
    and what is typed) is asked for. Where it begins as the rest of the target does, the
    common beginning is taken for one keystroke; else one character is typed.

    ``tests(test_id, prompt, target)``; ``predictions(context, guess)``, keyed by ``context``: of
    equal contexts the least guess counts, a missing, null or blank one is no prediction. One
    row a test: ``keystrokes, accepted, typed, auto, csr``; a null or empty target takes
    none and has a null ``csr``, and repeated tests each have a row. No test takes over
    ``most`` keystrokes. With ``steps`` instead a row a keystroke, ``step, context, guess,
    matched, typed``.

    A target's words meet the guesses for their beginnings by key; the distinct words after a
    distinct text are looked up once. A test's row holds the guesses of its own words alone.
    """
    spark = tests.sparkSession
    prompt = F.coalesce("prompt", F.lit(""))
    if order is not None:  # no prediction sees more of the prompt
        prompt = text.let(F.split(prompt, " "), lambda p: F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - order + 1), F.lit(order)), " "))
    begun = tests.select("test_id", prompt.alias("prompt"), F.coalesce("target", F.lit("")).alias("target"), F.monotonically_increasing_id().alias("row"))
    begun = staged(begun, "tests")
    known = predictions.filter("context IS NOT NULL").groupBy("context").agg(F.min("guess").alias("guess"))
    known = known.withColumn("guess", F.ltrim("guess")).filter("guess <> ''")
    words = _words(begun, order)
    guesses = staged(_guesses(words, known), "guesses")
    placed = F.transform("found", lambda x: F.struct((F.col("at") + x["k"]).alias("at"), x["guess"].alias("guess")))
    own = words.join(guesses, ["head", "word"]).select("row", placed.alias("found")).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"))
    walked = begun.join(own, "row", "left").withColumn("walk", _walk(order, most)(F.col("target"), F.col("found.at"), F.col("found.guess")))
    if steps:
        each = walked.filter("size(walk) > 0").select("test_id", "prompt", "target", F.posexplode("walk").alias("step", "w")).select("test_id", (F.col("step") + 1).alias("step"), "prompt", "target", "w.*")
        return each.select("test_id", "step", _asked(F.col("prompt"), F.col("target"), F.col("at"), order).alias("context"), "guess", "matched", F.expr("left(target, at + greatest(matched, 1))").alias("typed"))
    total = lambda c: F.aggregate(F.transform("walk", c), F.lit(0), lambda a, x: a + x)
    keys, chars = F.size("walk"), F.length("target")
    return walked.select(
        "test_id", keys.alias("keystrokes"), total(lambda w: (w["matched"] > 0).cast("int")).alias("accepted"), total(lambda w: F.greatest(w["matched"], F.lit(1))).alias("typed"),
        total(lambda w: w["matched"]).alias("auto"), ((chars - keys) / F.nullif(chars, F.lit(0))).alias("csr"),
    )


def _asked(prompt: Column, target: Column, at: Column, order: int | None) -> Column:
    """What is asked for where ``at`` characters of the target are typed."""
    typed = context(F.concat(prompt, F.lit(" "), F.left(target, at)), order)
    return typed if order is not None else F.when(at == 0, prompt).otherwise(typed)


def _words(begun: DataFrame, order: int | None) -> DataFrame:
    """``row, at, head, word``: where each word of a target begins and what is asked for there; it goes on
    with the word's characters. Without an order the first place is asked for by the prompt
    alone, without a space, which is listed at -1."""
    parts = begun.filter("target <> ''").withColumn("parts", F.split("target", " "))
    each = parts.select("row", "prompt", "target", F.posexplode("parts").alias("no", "word"), "parts")
    at = F.when(F.col("no") == 0, 0).otherwise(F.length(F.array_join(F.slice("parts", F.lit(1), F.col("no")), " ")) + 1)
    each = each.select("row", at.alias("at"), "prompt", "target", "word")
    words = each.select("row", "at", context(F.expr("concat(prompt, ' ', left(target, at))"), order).alias("head"), "word")
    if order is None:
        words = words.unionByName(begun.filter("target <> ''").select("row", F.lit(-1).alias("at"), F.col("prompt").alias("head"), F.lit("").alias("word")))
    return words


def _guesses(words: DataFrame, known: DataFrame) -> DataFrame:
    """``head, word, found``: the guesses after the head and each beginning of the word, by its length."""
    pairs = words.select("head", "word").distinct()
    begun = pairs.select("head", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("k"))
    met = begun.withColumn("context", F.expr("concat(head, left(word, k))")).join(known, "context")
    return met.groupBy("head", "word").agg(F.collect_list(F.struct("k", "guess")).alias("found"))


def _walk(order: int | None, most: int):
    """Steps of a test: how much was typed before each, the guess, and how much of it was taken."""

    @F.pandas_udf("array<struct<at int, guess string, matched int>>")
    def walk(targets: pd.Series, places: pd.Series, guesses: pd.Series) -> pd.Series:
        out = []
        for target, at, found in zip(targets, places, guesses, strict=True):
            guess = {} if at is None else dict(zip(at.tolist(), found, strict=True))
            if order is None:
                guess[0] = guess.get(-1, "")
            done, steps = 0, []
            while done < len(target) and len(steps) < most:
                own, n = guess.get(done, ""), 0
                while n < len(own) and done + n < len(target) and own[n] == target[done + n]:
                    n += 1
                steps.append({"at": done, "guess": own, "matched": n})
                done += max(n, 1)
            out.append(steps)
        return pd.Series(out)

    return walk
