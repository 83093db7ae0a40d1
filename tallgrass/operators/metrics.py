"""Evaluation metrics over prediction tables, and a count-based predictor as the default source of predictions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text


def next_words(texts: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, prev, word``: each word with the one before it."""
    w = texts.select("conv_id", "turn", text.words(F.lower("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(i.alias("pos"), F.get("w", i - 1).alias("prev"), F.get("w", i).alias("word")))
    return w.filter("size(w) > 1").select("conv_id", "turn", F.inline(pairs))


def bigram_predictions(pairs: DataFrame, k: int | None = 5) -> DataFrame:
    """``prev, rank, word, prob``: the ``k`` most frequent followers of a word (None: all), ties by spelling."""
    counts = pairs.groupBy("prev", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("prev")
    ranked = counts.withColumn("prob", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "word")))
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).select("prev", "rank", "word", "prob")


def first_prefixes(pairs: DataFrame) -> DataFrame:
    """``prev, word, typed``: after how many typed characters a word is the best completion of what is typed, the
    most frequent follower of ``prev`` that begins so (ties by spelling); words that never are have no row.
    The best of each beginning is a grouped minimum; a word's first is another."""
    counts = pairs.groupBy("prev", "word").agg(F.count("*").alias("n"))
    begun = counts.select("prev", "word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("k"))
    best = begun.groupBy("prev", F.left("word", F.col("k")).alias("begun")).agg(F.min_by("word", F.struct((-F.col("n")).alias("n"), F.col("word"))).alias("word"))
    return best.groupBy("prev", "word").agg(F.min(F.length("begun")).alias("typed"))


def next_word_csr(pairs: DataFrame, *by: str) -> DataFrame:
    """Keystrokes with the best completion taken as soon as it is the word: one for the space before it,
    those typed until then, and one to take it; a word that is never offered is typed whole. The
    word before is the whole one, also where it was completed."""
    x = pairs.join(first_prefixes(pairs), ["prev", "word"], "left")
    keys = 1 + F.coalesce(F.col("typed") + 1, F.length("word"))
    x = x.groupBy(*by).agg(F.count("*").alias("n"), F.count("typed").alias("accepted"), F.round(F.avg("typed"), 6).alias("avg_prefix"), F.sum(keys).alias("keystrokes"), F.sum(F.length("word") + 1).alias("chars"))
    return x.withColumn("csr", F.round(1 - F.col("keystrokes") / F.col("chars"), 6))


def csr(best: DataFrame) -> DataFrame:
    """Keystrokes for ``target`` when the best prediction ``guess`` is taken where it matches."""
    hit = text.prefix_match(F.col("guess"), F.col("target"))
    x = best.withColumn("matched", hit).withColumn("keystrokes", F.when(hit > 0, 1 + F.length("target") - hit).otherwise(F.length("target")))
    return x.withColumn("saved", F.length("target") - F.col("keystrokes")).withColumn("csr", F.col("saved") / F.length("target"))


def bootstrap_mean(df: DataFrame, value: str, group: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of a group's mean over ``n`` resamples. A resample gives each row a Poisson
    weight of mean one: equal values of a group share one draw of the mean that they count, by a
    generator of the seed, the group and the value. Tasks add up the resamples' sums of the groups
    that they see, so that neither a group nor its resamples are gathered. Empty groups have no row."""
    counted = df.select(group, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("c"))
    kind = df.schema[group].dataType.simpleString()

    def sums(batches):
        held: dict = {}

        def rows():
            for g, (w, s) in held.items():
                yield pd.DataFrame({group: [g] * n, "b": range(n), "w": w, "s": s})
            held.clear()

        for batch in batches:
            for g, v, c, h in zip(*(batch[k] for k in (group, "v", "c", "h")), strict=True):
                drawn = np.random.Generator(np.random.Philox(key=int(h) & (1 << 64) - 1)).poisson(c, n)
                w, s = held.setdefault(g, (np.zeros(n), np.zeros(n)))
                w += drawn
                s += drawn * v
            if len(held) > 500:
                yield from rows()
        yield from rows()

    drawn = counted.withColumn("h", F.xxhash64(F.lit(seed), group, "v")).mapInPandas(sums, f"`{group}` {kind}, b int, w double, s double")
    means = drawn.groupBy(group, "b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    spread = means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))  # n means a group
    whole = counted.groupBy(group).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    return whole.join(spread, group).select(group, "mean", "lo", "hi", "n")


def quantiles(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Values at given 0-based places (of ``n``, a group's count) in the order of a group's values, as columns
    of the given names. Values are counted by whole numbers first; only those of the whole number that
    holds a place are ordered, so that no group's values are ordered in one task."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cells = counted.groupBy(*by, F.floor("v").alias("cell")).agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "cell", "c", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()])
    cells = cells.withColumn("p", F.explode(wanted)).filter("p.place >= before AND p.place < before + c")
    held = cells.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("cell").alias("_cell"), "p", "before")
    match = F.floor("v") == F.col("_cell")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
    near = counted.join(held, match)
    inside = Window.partitionBy(*by, "p.name").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("lo", F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).filter("p.place >= lo AND p.place < lo + c")
    return near.groupBy(*by).agg(*[F.max(F.when(F.col("p.name") == k, F.col("v"))).alias(k) for k in places])


def summary_of(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``n, mean, lo, hi`` and interpolated percentiles by name of a group's values."""
    at = {k: q * (F.col("n") - 1) for k, q in shares.items()}
    ends = quantiles(rows, [by], value, {f"{k}_{e}": f(a) for k, a in at.items() for e, f in (("a", F.floor), ("b", F.ceil))})
    plain = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = plain.join(ends.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, "n", "mean", "lo", "hi", *[(F.col(f"{k}_a") + (F.col(f"{k}_b") - F.col(f"{k}_a")) * (a - F.floor(a))).alias(k) for k, a in at.items()])


def distance(a: str, b: str) -> int:
    """Edit distance of two texts, bit-parallel: a column of the table of prefixes is two integers, the
    places where it rises and where it falls, and a character of the shorter text moves both."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or not b:
        return len(a) - len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    whole, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rises, falls = whole, 0
    for c in b:
        same = where.get(c, 0)
        across = (((same & rises) + rises) ^ rises) | same
        up = falls | (whole & ~(across | rises))
        down = rises & across
        found += (up & last > 0) - (down & last > 0)
        up = (up << 1 | 1) & whole
        stays = same | falls
        rises = (down << 1 & whole) | (whole & ~(stays | up))
        falls = up & stays
    return found


def edit_distance(a: Column, b: Column) -> Column:
    """``distance`` of code points, in Arrow batches; null where either is. Whole texts are far
    quicker here than by the built-in function, whose time grows with the product of the lengths."""

    @F.pandas_udf("int")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return measured(a, b)


def edit_metrics(reference: Column, made: Column) -> dict[str, Column]:
    """Distance, accuracy, keystrokes saved, whether the made text ends too early (it isn't empty and the
    reference goes on from it), and the reference's length bucket."""
    d, longest = edit_distance(reference, made), F.greatest(F.length(reference), F.length(made))
    return {
        "distance": d,
        "char_accuracy": F.when(longest == 0, 1.0).otherwise(1 - d / longest),
        "keystrokes_saved": F.length(reference) - d,
        "truncated": reference.startswith(made) & F.length(made).between(1, F.length(reference) - 1),
        "bucket": F.when(F.length(reference) < 15, "short").when(F.length(reference) < 30, "medium").otherwise("long"),
    }


def learning_rate(step: Column, peak: float, least: float, warmup: int, steps: int | Column) -> Column:
    """Linear warm-up (a tenth of all steps at most), then a cosine down to ``least``."""
    steps = steps if isinstance(steps, Column) else F.lit(steps)
    up = F.least(F.lit(warmup), F.floor(steps / 10))
    at = F.least(F.lit(1.0), (step - up) / F.greatest(F.lit(1), steps - up))
    return F.when(step < up, peak * (step + 1) / F.greatest(F.lit(1), up)).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(F.lit(math.pi) * at)))


def binomial_test(wins: Column, n: Column) -> Column:
    """The two-sided p-value of so many wins of ``n`` at even odds: all outcomes that are no likelier. One without pairs."""
    log = lambda k: F.log(k.cast("double"))
    begin = F.struct((-n * F.log(F.lit(2.0))).alias("last"), F.array((-n * F.log(F.lit(2.0)))).alias("all"))

    def step(a: Column, k: Column) -> Column:
        now = a["last"] + log(n - k + 1) - log(k)
        return F.struct(now.alias("last"), F.concat(a["all"], F.array(now)).alias("all"))

    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), begin, step, lambda a: a["all"])
    own = lambda p: F.get(p, wins.cast("int")) + 1e-9
    total = text.let(logs, lambda p: F.aggregate(F.filter(p, lambda x: x <= own(p)), F.lit(0.0), lambda a, x: a + F.exp(x)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), total))


def softmax_top(logits: Column, k: int) -> Column:
    """``id, prob`` of the ``k`` likeliest entries of an array of logits."""
    exps = text.let(logits, lambda x: text.let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))

    def likeliest(e: Column) -> Column:
        order = F.slice(F.array_sort(F.transform(e, lambda v, i: F.struct((-v).alias("p"), i.alias("id")))), 1, k)
        return text.let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda whole: F.transform(order, lambda x: F.struct(x["id"].alias("id"), (-x["p"] / whole).alias("prob"))))

    return text.let(exps, likeliest)


def is_repetitive(ids: Column) -> Column:
    return (F.size(ids) > 4) & (F.size(F.array_distinct(ids)) < 0.4 * F.size(ids))


def cut_at_stop(ids: Column, stop: int | Column) -> Column:
    at = F.array_position(ids, stop)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def best_of(candidates: DataFrame, key: str) -> DataFrame:
    """The non-empty candidate of highest confidence (the first of ties) of each key, else ('', 0, 'stop')."""
    real = F.when(F.col("text") != "", F.struct("confidence", -F.col("idx")))
    best = F.max_by(F.struct("text", "confidence", "finish"), real)
    x = candidates.groupBy(key).agg(best.alias("b"), F.max(real).alias("any"))
    ok = F.col("any").isNotNull()
    return x.select(key, F.when(ok, F.col("b.text")).otherwise("").alias("text"), F.when(ok, F.col("b.confidence")).otherwise(0.0).alias("confidence"), F.when(ok, F.col("b.finish")).otherwise("stop").alias("finish"))


def parse_judgments(answers: Column) -> Column:
    """Map of pair number to A, B or T; the last judgment of a pair wins."""
    n = F.regexp_extract_all(answers, F.lit(r"(\d+)\s*[:=.]?\s*([ABT])"), F.lit(1))
    s = F.regexp_extract_all(answers, F.lit(r"(\d+)\s*[:=.]?\s*([ABT])"), F.lit(2))
    both = F.arrays_zip(n.alias("n"), s.alias("s"))
    last = F.filter(both, lambda x, i: ~F.array_contains(F.slice(n, i + 2, F.size(n)), x["n"]))
    return F.map_from_entries(last)


def trend(steps: DataFrame, step: str, value: str) -> DataFrame:
    """A value at the first three steps and an arrow from the first to the third."""
    x = steps.withColumn("_k", F.row_number().over(Window.orderBy(step)))  # a row a checkpoint
    x = x.groupBy().pivot("_k", [1, 2, 3]).agg(F.first(value)).toDF("first", "second", "third")
    arrow = F.when(F.col("third") > F.col("first"), "↑").when(F.col("third") < F.col("first"), "↓").otherwise("→")
    return x.withColumn("trend", arrow)


def compared(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean with its normal interval, and counts of methods, by checkpoint."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count("*"))
    at = lambda m: F.count_if(F.col("method") == m).alias(m)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(value) - half, 6).alias("lo"), F.round(F.avg(value) + half, 6).alias("hi"), at("completion"), at("manual"))


def disagreements(ranks: DataFrame, case: list[str], steps: int = 2) -> DataFrame:
    """Cases with more than one rank over ``(step, rank)``; a missing rank is -1."""
    known = F.coalesce("rank", F.lit(-1))
    x = ranks.groupBy(*case).agg(F.count_distinct(known).alias("_n"), *[F.max(F.when(F.col("step") == k, known)).alias(f"r{k}") for k in range(steps)])
    return x.filter("_n > 1").drop("_n")


def mean_of_means(rows: DataFrame, by: str, prompt: str, value: str) -> DataFrame:
    """Means of prompts' means, their peak, and the mean of each prompt's element at int(0.95 n)."""
    late = quantiles(rows, [by, prompt], value, {"p95": F.floor(0.95 * F.col("n"))})
    means = rows.groupBy(by, prompt).agg(F.avg(value).alias("mean"))
    m = means.join(late, [by, prompt])
    return m.groupBy(by).agg(F.count("*").alias("prompts"), F.round(F.avg("mean"), 6).alias("mean_of_means"), F.round(F.max("mean"), 6).alias("peak"), F.round(F.avg("p95"), 6).alias("p95"))
