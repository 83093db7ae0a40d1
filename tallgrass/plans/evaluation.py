"""Registered queries: evaluation metrics, suggestion repair, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import draws, metrics, simulation, telemetry
from tallgrass.plans.registry import ORACLE, query
from tallgrass.sources.corpus import table
from tallgrass.sources.telemetry import telemetry as as_telemetry
from tallgrass.streaming.jobs import run_ignored, run_live_batches, run_live_ignored, run_timeline

_W = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
PAIRS = f"""w AS (SELECT conv_id, turn, {_W} AS w FROM conversations), i AS (SELECT *, unnest(range(1, len(w))) AS pos FROM w), pairs AS (SELECT conv_id, turn, pos, w[pos] AS prev, w[pos + 1] AS word FROM i),
 cn AS (SELECT prev, word, count(*) AS n FROM pairs GROUP BY 1, 2), pr AS (SELECT prev, word, n / sum(n) OVER (PARTITION BY prev) AS prob, row_number() OVER (PARTITION BY prev ORDER BY n DESC, word) AS rank FROM cn), pred AS (SELECT * FROM pr WHERE rank <= 5)"""
ALL = PAIRS.replace(" WHERE rank <= 5", "")  # every follower of a word
_MATCH = "list_reduce(list_prepend(0, range(1, least(length(guess), length(target)) + 1)), lambda a, i: CASE WHEN a = i - 1 AND substr(guess, i, 1) = substr(target, i, 1) THEN i ELSE a END)"
BEST = f"""best AS (SELECT conv_id, turn, pos, p.word AS target, coalesce(g.word, '') AS guess FROM pairs p LEFT JOIN pred g ON p.prev = g.prev AND g.rank = 1),
 mt AS (SELECT *, {_MATCH} AS matched FROM best), cs AS (SELECT *, CASE WHEN matched > 0 THEN matched - 1 ELSE 0 END AS saved FROM mt)"""


def _pairs(spark, d) -> DataFrame:
    return metrics.next_words(table(spark, d, "conversations"))


def _best(spark, d) -> DataFrame:
    p = _pairs(spark, d)
    top = metrics.bigram_predictions(p, 1).select("prev", F.col("word").alias("guess"))
    return p.join(top, "prev", "left").select("conv_id", "turn", "pos", F.col("word").alias("target"), F.coalesce("guess", F.lit("")).alias("guess"))


@query("ngram_predict", f"WITH {PAIRS} SELECT prev, CAST(rank AS INTEGER) AS rank, word, round(prob, 6) AS prob FROM pred")
def ngram_predict(spark, d):
    return metrics.bigram_predictions(_pairs(spark, d)).withColumn("prob", F.round("prob", 6))


@query("csr_prefix_match", f"WITH {PAIRS}, {BEST} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, target, guess, CAST(matched AS INTEGER) AS matched FROM mt")
def csr_prefix_match(spark, d):
    return metrics.csr(_best(spark, d)).select("conv_id", "turn", "pos", "target", "guess", "matched")


@query("csr_macro_micro", f"""WITH {PAIRS}, {BEST}, r AS (SELECT role, saved, length(target) AS chars FROM cs JOIN conversations USING (conv_id, turn))
  SELECT coalesce(role, 'all') AS role, count(*) AS n, round(avg(saved / chars), 6) AS macro, round(sum(saved) / sum(chars), 6) AS micro, CAST(sum(CASE WHEN saved > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM r GROUP BY GROUPING SETS ((role), ())""")
def csr_macro_micro(spark, d):
    x = metrics.csr(_best(spark, d)).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    x = x.rollup("role").agg(F.count("*").alias("n"), F.round(F.avg("csr"), 6).alias("macro"), F.round(F.sum("saved") / F.sum(F.length("target")), 6).alias("micro"), F.count_if(F.col("saved") > 0).alias("wins"))
    return x.withColumn("role", F.coalesce("role", F.lit("all")))


# Sentences of 8 words or more, cut in the middle; the second half, of 4 to 10 words and 70 characters at most, is typed.
_TYPED = f"""RECURSIVE {PAIRS}, sn AS (SELECT conv_id, turn, unnest(range(len(p))) AS no, unnest(p) AS s FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[.!?\\n]+') AS p FROM conversations)),
 sw AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w FROM sn), sh AS (SELECT *, len(w) // 2 AS mid FROM sw WHERE len(w) >= 8),
 tests AS (SELECT conv_id || '/' || turn || '/' || no AS test_id, w[mid] AS prompt, array_to_string(w[mid + 1 :], ' ') AS target FROM sh WHERE len(w) - mid BETWEEN 4 AND 10 AND length(array_to_string(w[mid + 1 :], ' ')) <= 70),
 bg AS (SELECT prev || ' ' || left(word, k) AS context, word, n, k FROM (SELECT *, unnest(range(length(word))) AS k FROM cn)),
 kn AS (SELECT b.context, concat_ws(' ', substr(b.word, b.k + 1), pr.word) AS guess FROM (SELECT * FROM bg QUALIFY row_number() OVER (PARTITION BY context ORDER BY n DESC, word) = 1) b LEFT JOIN pr ON pr.prev = b.word AND pr.rank = 1),
 typing(test_id, prompt, target, step, done, accepted, auto, matched, guess, context) AS (
  SELECT test_id, prompt, target, 0, 0, 0, 0, 0, '', '' FROM tests
  UNION ALL
  SELECT test_id, prompt, target, step + 1, done + greatest(m, 1), accepted + CASE WHEN m > 0 THEN 1 ELSE 0 END, auto + m, m, guess, context FROM (
   SELECT *, CAST(list_reduce(list_prepend(0, range(1, least(length(guess), length(rest)) + 1)), lambda a, i: CASE WHEN a = i - 1 AND substr(guess, i, 1) = substr(rest, i, 1) THEN i ELSE a END) AS INTEGER) AS m FROM (
    SELECT t.test_id, t.prompt, t.target, t.step, t.done, t.accepted, t.auto, substr(t.target, t.done + 1) AS rest, coalesce(kn.guess, '') AS guess, t.context
    FROM (SELECT * EXCLUDE (context), array_to_string(list_slice(string_split(prompt || ' ' || left(target, done), ' '), -2, -1), ' ') AS context FROM typing WHERE done < length(target)) t LEFT JOIN kn ON kn.context = t.context)))"""


def _typing_tests(spark, d) -> DataFrame:
    s = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), "[.!?\\n]+")).alias("no", "s"))
    s = s.withColumn("w", text.words(F.col("s"))).filter("size(w) >= 8").withColumn("mid", F.expr("size(w) div 2").cast("int"))
    s = s.withColumn("after", F.expr("slice(w, mid + 1, size(w))")).withColumn("target", F.array_join("after", " "))
    return s.filter("size(after) BETWEEN 4 AND 10 AND length(target) <= 70").select(F.concat_ws("/", "conv_id", "turn", "no").alias("test_id"), F.get("w", F.col("mid") - 1).alias("prompt"), "target", "after")


def _typed(spark, d, steps: bool) -> DataFrame:
    tests = _typing_tests(spark, d)
    asked = tests.select(F.explode(F.zip_with(F.concat(F.array("prompt"), "after"), F.col("after"), lambda p, w: F.struct(p.alias("p"), w.alias("w")))).alias("x")).filter("x.w IS NOT NULL").distinct()
    wanted = asked.select("x.p", F.expr("explode(transform(sequence(0, length(x.w)), k -> left(x.w, k)))").alias("b")).select(F.concat_ws(" ", "p", "b").alias("context"))
    return simulation.simulate_csr(tests, simulation.completions(_pairs(spark, d), wanted), order=1, steps=steps)


@query("csr_simulation", f"WITH {_TYPED} SELECT test_id, max(step) AS keystrokes, max(accepted) AS accepted, max(done) AS typed, max(auto) AS auto, round((length(any_value(target)) - max(step)) / length(any_value(target)), 6) AS csr FROM typing GROUP BY test_id")
def csr_simulation(spark, d):
    return _typed(spark, d, False).withColumn("csr", F.round("csr", 6))


@query("csr_trace", f"WITH {_TYPED} SELECT test_id, step, context, guess, matched, left(target, done) AS typed FROM typing WHERE step > 0")
def csr_trace(spark, d):
    return _typed(spark, d, True)


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    x = metrics.csr(_best(spark, d)).groupBy("conv_id").agg(F.avg("csr").alias("csr"))
    return metrics.bootstrap_mean(x.withColumn("set", F.concat(F.lit("s"), F.pmod("conv_id", F.lit(4)).cast("string"))), "csr", "set")


@query("bootstrap_exact")
def bootstrap_exact(spark, d):
    """The interval of the mean savings of a conversation, by the seeded generator's own resamples."""
    x = metrics.csr(_best(spark, d)).groupBy("conv_id").agg(F.avg("csr").alias("csr"))
    return draws.bootstrap_interval(x, "csr", ["conv_id"])


@query("nw_csr_simplified", f"WITH {PAIRS}, b AS (SELECT prev, word, n, unnest(range(length(word) + 1)) AS k FROM cn), t AS (SELECT prev, left(word, k) AS begun, arg_min(word, {{'n': -n, 'w': word}}) AS word FROM b GROUP BY ALL), f AS (SELECT prev, word, min(length(begun)) AS typed FROM t GROUP BY ALL), x AS (SELECT role, p.word, typed, 1 + coalesce(typed + 1, length(p.word)) AS keys FROM pairs p JOIN conversations USING (conv_id, turn) LEFT JOIN f ON f.prev = p.prev AND f.word = p.word) SELECT role, count(*) AS n, count(typed) AS accepted, round(avg(typed), 6) AS avg_prefix, CAST(sum(keys) AS BIGINT) AS keystrokes, CAST(sum(length(word) + 1) AS BIGINT) AS chars, round(1 - sum(keys) / sum(length(word) + 1), 6) AS csr FROM x GROUP BY role")
def nw_csr_simplified(spark, d):
    """Every beginning of a word is tried, from none to all of it, by role."""
    p = _pairs(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return metrics.next_word_csr(p, "role")


@query("morphacc_semijoin", f"WITH {PAIRS}, t AS (SELECT prev, list_distinct(list(left(word, 2))) AS valid FROM pairs JOIN conversations c USING (conv_id, turn) WHERE c.role = 'user' GROUP BY prev), h AS (SELECT t.prev, min(CASE WHEN len(list_filter(valid, lambda s: starts_with(g.word, s))) > 0 THEN g.rank END) AS first_rank, sum(CASE WHEN len(list_filter(valid, lambda s: starts_with(g.word, s))) > 0 THEN g.prob ELSE 0 END) AS mass FROM t JOIN pred g ON t.prev = g.prev GROUP BY t.prev) SELECT prev, CAST(first_rank AS INTEGER) AS first_rank, round(mass, 6) AS mass FROM h")
def morphacc_semijoin(spark, d):
    p = _pairs(spark, d)
    asked = p.join(table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    valid = asked.groupBy("prev").agg(F.collect_set(F.left("word", F.lit(2))).alias("valid"))
    x = metrics.bigram_predictions(p).join(valid, "prev").withColumn("hit", F.exists("valid", lambda s: F.col("word").startswith(s)))
    return x.groupBy("prev").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.round(F.sum(F.when(F.col("hit"), F.col("prob")).otherwise(0.0)), 6).alias("mass"))


@query("paradigm_rank", f"WITH {ALL}, roots AS (SELECT DISTINCT prev FROM pred WHERE length(prev) > 6), k AS (SELECT unnest(['th', 'er', 'an', 'in']) AS suffix), b AS (SELECT r.prev, k.suffix, max(g.prob) AS best FROM roots r CROSS JOIN k JOIN pred g ON g.prev = r.prev AND starts_with(g.word, k.suffix) GROUP BY ALL) SELECT b.prev, b.suffix, CAST(1 + (SELECT count(*) FROM pred g WHERE g.prev = b.prev AND g.prob > b.best) AS BIGINT) AS rank FROM b")
def paradigm_rank(spark, d):
    pred = metrics.bigram_predictions(_pairs(spark, d), None).filter(F.length("prev") > 6)
    ranked = pred.withColumn("r", F.rank().over(Window.partitionBy("prev").orderBy(F.desc("prob"))))
    # the case list is fixed, so roots x cases is an explode of a literal, not a join
    cased = ranked.select("prev", "word", "r", F.explode(F.array(*map(F.lit, ("th", "er", "an", "in")))).alias("suffix")).filter("startswith(word, suffix)")
    return cased.groupBy("prev", "suffix").agg(F.min("r").cast("long").alias("rank"))


# DuckDB's distance counts bytes: the tables' letters beyond ASCII become control characters there, which no text has.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = "".join(map(chr, [*range(1, 9), *range(14, 27)]))
_ED = f"e AS (SELECT translate(text, '{_WIDE}', '{_NARROW}') AS r, lead(translate(text, '{_WIDE}', '{_NARROW}')) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations), q AS (SELECT *, levenshtein(r, g) AS dist FROM e WHERE g IS NOT NULL)"


@query("edit_metrics", f"""WITH {_ED} SELECT CASE WHEN length(r) < 15 THEN 'short' WHEN length(r) < 30 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, CAST(sum(CASE WHEN r = g THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(dist) AS BIGINT) AS distance,
 round(avg(CASE WHEN greatest(length(r), length(g)) = 0 THEN 1.0 ELSE 1 - dist / greatest(length(r), length(g)) END), 6) AS char_accuracy, CAST(sum(length(r) - dist) AS BIGINT) AS saved, round(100.0 * sum(length(r) - dist) / sum(length(r)), 6) AS saved_pct,
 CAST(sum(CASE WHEN starts_with(r, g) AND length(g) BETWEEN 1 AND length(r) - 1 THEN 1 ELSE 0 END) AS BIGINT) AS truncated FROM q GROUP BY 1""")
def edit_metrics(spark, d):
    """Each turn as the reference of the next, over whole texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").select(F.col("text").alias("r"), F.lead("text").over(w).alias("g")).filter("g IS NOT NULL")
    x = x.select((F.col("r") == F.col("g")).alias("exact"), F.length("r").alias("chars"), *[c.alias(k) for k, c in metrics.edit_metrics(F.col("r"), F.col("g")).items()])
    return x.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.sum("distance").alias("distance"), F.round(F.avg("char_accuracy"), 6).alias("char_accuracy"), F.sum("keystrokes_saved").alias("saved"),
        F.round(100.0 * F.sum("keystrokes_saved") / F.sum("chars"), 6).alias("saved_pct"), F.count_if("truncated").alias("truncated"),
    )


WORD_MODEL = f"u AS (SELECT doc_id, lang, source, unnest({_W}) AS w FROM documents), lp AS (SELECT w, ln(n / sum(n) OVER ()) AS lp FROM (SELECT w, count(*) AS n FROM u GROUP BY w))"


def word_model(spark, d) -> tuple[DataFrame, DataFrame]:
    """The words of the documents with id, language and source, and ``w, lp``: the counted unigram model of them."""
    words = table(spark, d, "documents").select("doc_id", "lang", "source", F.explode(text.words(F.lower("text"))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("t"))  # one row
    return words, counts.join(F.broadcast(whole)).select("w", F.log(F.col("n") / F.col("t")).alias("lp"))


@query("ppl_bpc_rollup", f"WITH {WORD_MODEL}, b AS (SELECT source, count(*) AS tokens, sum(-lp / ln(2)) AS bits FROM u JOIN lp USING (w) GROUP BY source), x AS (SELECT b.*, chars FROM b JOIN (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY 1) USING (source)) SELECT coalesce(source, 'all') AS source, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(bits) / sum(chars), 6) AS bpc, round(exp(least(sum(bits) * ln(2) / sum(tokens), 20)), 4) AS ppl, round(sum(tokens) / sum(chars), 6) AS tokens_per_char FROM x GROUP BY GROUPING SETS ((source), ())")
def ppl_bpc_rollup(spark, d):
    """Bits a character and perplexity of each source under the counted word model; a source's words are
    counted before they meet the model, so that a frequent word is a row a source."""
    words, model = word_model(spark, d)
    held = words.groupBy("source", "w").agg(F.count("*").alias("k")).join(model, "w")
    b = held.groupBy("source").agg(F.sum("k").alias("tokens"), F.sum(-F.col("k") * F.col("lp") / F.log(F.lit(2.0))).alias("bits"))
    x = b.join(table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars")), "source")
    bits, ln2 = F.sum("bits"), F.log(F.lit(2.0))
    x = x.rollup("source").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.round(bits / F.sum("chars"), 6).alias("bpc"), F.round(F.exp(F.least(bits * ln2 / F.sum("tokens"), F.lit(20.0))), 4).alias("ppl"), F.round(F.sum("tokens") / F.sum("chars"), 6).alias("tokens_per_char"))
    return x.withColumn("source", F.coalesce("source", F.lit("all")))


@query("replay_hits", f"WITH {PAIRS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prev, word ORDER BY conv_id, turn, pos) AS k FROM pairs) WHERE k = 1), r AS (SELECT a.prev, a.word, min(CASE WHEN g.word = a.word THEN g.rank - 1 END) AS exact, max(CASE WHEN contains(g.word, a.word) OR contains(a.word, g.word) THEN 1 ELSE 0 END) AS fuzzy FROM a JOIN pred g ON g.prev = a.prev GROUP BY 1, 2) SELECT count(*) AS n, CAST(sum(CASE WHEN exact = 0 THEN 1 ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN exact <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS top3, CAST(sum(CASE WHEN exact IS NULL AND fuzzy = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fuzzy FROM r")
def replay_hits(spark, d):
    p = _pairs(spark, d)
    lists = metrics.bigram_predictions(p).groupBy("prev").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("guesses"))
    x = p.select("prev", "word").distinct().join(lists, "prev").withColumn("exact", F.array_position("guesses", F.col("word")))
    fuzzy = F.exists("guesses", lambda g: g.contains(F.col("word")) | F.col("word").contains(g))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("exact") == 1).alias("top1"), F.count_if(F.col("exact").between(1, 3)).alias("top3"), F.count_if((F.col("exact") == 0) & fuzzy).alias("fuzzy"))


_AB = "k AS (SELECT item_id AS n, ('0x' || substr(md5('42:' || item_id), 1, 7))::BIGINT % 2 = 0 AS a_is_old, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 3 = 0 THEN 'T' WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS judged FROM benchmark)"


def _judged(n: Column) -> tuple[Column, Column]:
    """Whether A hides the old one, and the judgment, of an item."""
    coin = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), n.cast("string"))), 1, 7), 16, 10).cast("long") % 2 == 0
    return coin, F.when(n % 5 == 0, None).when(n % 3 == 0, "T").when(n % 2 == 0, "A").otherwise("B")


@query("ab_reveal", f"WITH {_AB} SELECT CASE WHEN judged IS NULL THEN 'missing' WHEN judged = 'T' THEN 'tie' WHEN (judged = 'A') = a_is_old THEN 'old' ELSE 'new' END AS winner, count(*) AS n FROM k GROUP BY 1")
def ab_reveal(spark, d):
    n = F.col("item_id")
    coin, judged = _judged(n)
    winner = F.when(judged.isNull(), "missing").when(judged == "T", "tie").when((judged == "A") == coin, "old").otherwise("new")
    return table(spark, d, "benchmark").groupBy(winner.alias("winner")).agg(F.count("*").alias("n"))


_WON = f"{_AB}, g AS (SELECT n % 4 AS batch, count(*) FILTER (judged IN ('A', 'B')) AS n, count(*) FILTER (judged IN ('A', 'B') AND (judged = 'A') = a_is_old) AS wins FROM k GROUP BY 1)"


@query("ab_binomial", f"WITH {_WON}, t AS (SELECT batch, n, wins, unnest(range(n + 1)) AS k FROM g), p AS (SELECT batch, n, wins, k, CASE WHEN n = 0 THEN 1.0 ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) END AS p FROM t), o AS (SELECT batch, p AS own FROM p WHERE k = wins) SELECT batch, any_value(n) AS decided, any_value(wins) AS wins, round(least(1.0, sum(p) FILTER (p <= own * (1 + 1e-9))), 6) AS p_value FROM p JOIN o USING (batch) GROUP BY batch")
def ab_binomial(spark, d):
    """The two-sided test of the old one's wins among the decided pairs, by batch of items."""
    n = F.col("item_id")
    coin, judged = _judged(n)
    decided = judged.isin("A", "B")
    g = table(spark, d, "benchmark").groupBy((n % 4).alias("batch")).agg(F.count_if(decided).alias("decided"), F.count_if(decided & ((judged == "A") == coin)).alias("wins"))
    return g.withColumn("p_value", F.round(metrics.binomial_test(F.col("wins"), F.col("decided")), 6))


@query("overlap_stats", f"WITH w AS (SELECT conv_id, role, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s''-]', '', 'g'), '\\s+'), lambda x: x <> '') AS w FROM conversations), n AS (SELECT conv_id, role, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM w) SELECT coalesce(role, 'all') AS role, count(*) AS n, CAST(sum(CASE WHEN w[1] = nx[1] THEN 1 ELSE 0 END) AS BIGINT) AS first_same, CAST(sum(CASE WHEN len(list_intersect(w[1:3], nx[1:3])) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS any3 FROM n WHERE nx IS NOT NULL GROUP BY GROUPING SETS ((role), ())")
def overlap_stats(spark, d):
    w = text.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s'-]", ""))
    x = table(spark, d, "conversations").select("conv_id", "role", "turn", w.alias("w"))
    x = x.withColumn("nx", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("nx IS NOT NULL")
    x = x.rollup("role").agg(F.count("*").alias("n"), F.count_if(F.get("w", F.lit(0)) == F.get("nx", F.lit(0))).alias("first_same"), F.count_if(F.arrays_overlap(F.slice("w", 1, 3), F.slice("nx", 1, 3))).alias("any3"))
    return x.withColumn("role", F.coalesce("role", F.lit("all")))


_CLEAN_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s''-]', '', 'g'), '\\s+'), lambda x: x <> '')"


@query("overlap_buckets", f"WITH w AS (SELECT conv_id, turn, {_CLEAN_WORDS} AS w FROM conversations), n AS (SELECT w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM w), b AS (SELECT *, CASE WHEN len(w) < 10 THEN 'short' WHEN len(w) <= 15 THEN 'mid' ELSE 'long' END AS bucket FROM n WHERE nx IS NOT NULL) SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, count(*) FILTER (len(nx) > 0) AS nonempty, count(*) FILTER (w[1] = nx[1]) AS first_same, round(100.0 * count(*) FILTER (w[1] = nx[1]) / count(*), 4) AS first_pct, count(*) FILTER (len(list_intersect(w[1:3], nx[1:3])) > 0) AS any3, round(100.0 * count(*) FILTER (len(list_intersect(w[1:3], nx[1:3])) > 0) / count(*), 4) AS any3_pct FROM b GROUP BY GROUPING SETS ((bucket), ())")
def overlap_buckets(spark, d):
    """Overlap of a turn with the next by the turn's length, and of all."""
    x = table(spark, d, "conversations").select("conv_id", "turn", text.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s'-]", "")).alias("w"))
    x = x.withColumn("nx", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("nx IS NOT NULL")
    x = x.withColumn("bucket", F.when(F.size("w") < 10, "short").when(F.size("w") <= 15, "mid").otherwise("long"))
    first, any3 = F.count_if(F.get("w", F.lit(0)) == F.get("nx", F.lit(0))), F.count_if(F.arrays_overlap(F.slice("w", 1, 3), F.slice("nx", 1, 3)))
    pct = lambda c: F.round(100.0 * c / F.count("*"), 4)
    x = x.rollup("bucket").agg(F.count("*").alias("n"), F.count_if(F.size("nx") > 0).alias("nonempty"), first.alias("first_same"), pct(first).alias("first_pct"), any3.alias("any3"), pct(any3).alias("any3_pct"))
    return x.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


@query("latency_percentiles", "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    x = metrics.summary_of(table(spark, d, "events").select(F.col("event_type").alias("name"), "value"), "name", "value", {"p50": 0.5, "p95": 0.95})
    return x.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")], "lo", "hi")


@query("best_so_far", "WITH x AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events) SELECT user_id, event_id, best, coalesce(best < lag(best) OVER (PARTITION BY user_id ORDER BY event_id), true) AS improved FROM x")
def best_so_far(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").select("user_id", "event_id", F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"))
    return x.withColumn("improved", F.coalesce(F.col("best") < F.lag("best").over(w), F.lit(True)))


@query("lr_schedule", "WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, s AS step, round(CASE WHEN s < least(50, n // 10) THEN 0.001 * (s + 1) / greatest(1, least(50, n // 10)) ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * least(1.0, (s - least(50, n // 10)) / greatest(1, n - least(50, n // 10))))) END, 9) AS lr FROM s")
def lr_schedule(spark, d):
    """The rate at each event of a user's run: the events are its steps."""
    w = Window.partitionBy("user_id")
    x = table(spark, d, "events").select("event_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("step"), F.count("*").over(w).alias("n"))
    return x.select("event_id", "step", F.round(metrics.learning_rate(F.col("step"), 1e-3, 1e-4, 50, F.col("n")), 9).alias("lr"))


@query("nucleus_mask", f"WITH {ALL}, c AS (SELECT prev, word, prob, sum(prob) OVER (PARTITION BY prev ORDER BY prob DESC, word ROWS UNBOUNDED PRECEDING) - prob AS before FROM pred) SELECT prev, word, round(before, 6) < 0.6 AS kept FROM c")
def nucleus_mask(spark, d):
    w = Window.partitionBy("prev").orderBy(F.desc("prob"), "word").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.bigram_predictions(_pairs(spark, d), None).select("prev", "word", (F.round(F.sum("prob").over(w) - F.col("prob"), 6) < 0.6).alias("kept"))


_P = "[.!,?;:()\\[\\]{}]"


@query("filter_suggestion", f"WITH x AS (SELECT doc_id, text AS s FROM documents), t AS (SELECT doc_id, s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\s+$', ''), '\\s+', ' ', 'g'), '({_P}){_P}+', '\\1', 'g'), '(?: {_P}+)+$', '') AS r FROM x) SELECT doc_id, CASE WHEN starts_with(s, chr(10)) THEN '' WHEN regexp_matches(r, '\\p{{L}}') OR trim(r) = '' THEN r WHEN regexp_matches(r, '^{_P}$') THEN r ELSE '' END AS filtered FROM t")
def filter_suggestion(spark, d):
    return table(spark, d, "documents").select("doc_id", text.filter_suggestion(F.col("text")).alias("filtered"))


@query("confidence", "WITH x AS (SELECT user_id, list(-(value / 100) ORDER BY event_id) AS lp FROM events GROUP BY user_id), r AS (SELECT user_id, len(lp) AS n, list_filter(lp, lambda p: p < -0.01) AS lp FROM x) SELECT user_id, CASE WHEN n = 0 THEN 1.0 WHEN len(lp) = 0 THEN 0.0 ELSE round(list_avg(list_transform(lp, lambda p: exp(p))), 4) END AS confidence FROM r")
def confidence(spark, d):
    return text.grouped_confidence(table(spark, d, "events").select("user_id", (-(F.col("value") / 100)).alias("lp")), "user_id", "lp")


_GH = "g AS (SELECT item_id, left(text, length(text) // 2) AS t, length(text) // 3 AS c, substr(text, length(text) // 3 + 1) AS s0 FROM benchmark), e AS (SELECT item_id, substr(t, c + 1) AS ex, CASE WHEN right(t, 1) <> '' AND contains('{0}', right(t, 1)) AND left(s0, 1) = right(t, 1) THEN substr(s0, 2) ELSE s0 END AS s FROM g)".format(text.PUNCTUATION.replace("'", "''"))


@query("ghost_suffix", f"WITH {_GH} SELECT item_id, CASE WHEN h IS NULL THEN s ELSE substr(s, h + 1) END AS ghost FROM (SELECT *, list_max(list_filter(range(1, least(length(ex), length(s)) + 1), lambda i: lower(left(s, i)) = lower(right(ex, i)))) AS h FROM e)")
def ghost_suffix(spark, d):
    """The context is a third of an item and the typed text a half; the suggestion is all that follows the context."""
    b = table(spark, d, "benchmark")
    third, half = F.expr("length(text) div 3"), F.expr("length(text) div 2")
    return b.select("item_id", text.ghost_suffix(F.left("text", half), F.left("text", third), F.substring("text", third + 1, F.length("text"))).alias("ghost"))


@query("candidates_topk", f"WITH {ALL}, u AS (SELECT prev, left(word, 4) AS key, max(prob) AS prob FROM pred GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY prob DESC, key) AS k FROM u) SELECT prev, key, round(prob, 4) AS prob, CAST(k AS INTEGER) AS k FROM r WHERE k <= 3")
def candidates_topk(spark, d):
    u = metrics.bigram_predictions(_pairs(spark, d), None).groupBy("prev", F.left("word", F.lit(4)).alias("key")).agg(F.max("prob").alias("prob"))
    r = u.withColumn("k", F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("prob"), "key"))).filter("k <= 3")
    return r.select("prev", "key", F.round("prob", 4).alias("prob"), "k")


@query("best_of_n", "WITH c AS (SELECT conv_id, turn AS idx, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text, round((turn * 7 % 5) / 5, 2) AS confidence FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY text = '', confidence DESC, idx) AS k FROM c) SELECT conv_id, text, CASE WHEN text = '' THEN 0.0 ELSE confidence END AS confidence, CASE WHEN text = '' THEN 'stop' ELSE 'length' END AS finish FROM r WHERE k = 1")
def best_of_n(spark, d):
    t = F.col("turn")
    c = table(spark, d, "conversations").select("conv_id", t.alias("idx"), F.when(t % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.round((t * 7 % 5) / 5, 2).alias("confidence"), F.lit("length").alias("finish"))
    return metrics.best_of(c, "conv_id")


@query("partial_accept", "WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '\\s*\\S+\\s*')) AS part, unnest(range(len(regexp_extract_all(text, '\\s*\\S+\\s*')))) AS k FROM benchmark) SELECT item_id, CAST(k AS INTEGER) AS k, CAST(sum(length(part)) OVER (PARTITION BY item_id ORDER BY k) AS BIGINT) AS accepted FROM p")
def partial_accept(spark, d):
    p = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\s*\S+\s*"), F.lit(0))).alias("k", "part"))
    return p.select("item_id", "k", F.sum(F.length("part")).over(Window.partitionBy("item_id").orderBy("k")).alias("accepted"))


# --- telemetry -------------------------------------------------------------------------------------


def _tele(spark, d) -> DataFrame:
    return as_telemetry(table(spark, d, "events"))


@query("tele_recent", "WITH TELE SELECT id, model, event_type FROM tele ORDER BY id DESC LIMIT 100")
def tele_recent(spark, d):
    return telemetry.recent(_tele(spark, d)).select("id", "model", "event_type")


@query("tele_models", "WITH TELE SELECT model, count(*) AS n FROM tele GROUP BY model")
def tele_models(spark, d):
    return _tele(spark, d).groupBy("model").agg(F.count("*").alias("n"))


@query("tele_trailing", "WITH TELE SELECT model, count(*) AS n FROM tele WHERE timestamp >= (SELECT max(timestamp) FROM tele) - INTERVAL 48 HOUR GROUP BY model")
def tele_trailing(spark, d):
    return telemetry.trailing(_tele(spark, d), 48).groupBy("model").agg(F.count("*").alias("n"))


@query("tele_stats", """WITH TELE, q AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM tele WHERE event_type = 'suggested'),
  p AS (SELECT model, round(max(CASE WHEN k = n // 2 THEN latency_ms END), 1) AS p50, round(max(CASE WHEN k = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN latency_ms END), 1) AS p95 FROM q GROUP BY model),
  s AS (SELECT model, count(*) FILTER (event_type = 'suggested') AS suggested, count(*) FILTER (event_type = 'accepted') AS accepted, count(*) FILTER (event_type = 'partially_accepted') AS partially_accepted, count(*) FILTER (event_type = 'rejected') AS rejected,
   count(*) FILTER (event_type = 'ignored') AS ignored, round(avg(confidence) FILTER (event_type = 'suggested'), 6) AS avg_confidence, count(DISTINCT suggestion_id) FILTER (event_type IN ('accepted', 'partially_accepted', 'rejected')) AS engaged FROM tele GROUP BY model)
  SELECT s.*, p50, p95, round(accepted / suggested, 4) AS acceptance, round(engaged / suggested, 4) AS engagement FROM s JOIN p USING (model)""")
def tele_stats(spark, d):
    return telemetry.statistics(_tele(spark, d))


@query("tele_timeline", "WITH TELE SELECT date_trunc('hour', timestamp) AS bucket, model, count(*) AS n, count(*) FILTER (event_type = 'suggested') AS suggested FROM tele GROUP BY 1, 2")
def tele_timeline(spark, d):
    return telemetry.timeline(_tele(spark, d), 24).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("tele_pivot", "WITH TELE SELECT CAST(date_trunc('day', timestamp) AS DATE) AS day, count(*) FILTER (model = 'm0') AS m0, count(*) FILTER (model = 'm1') AS m1, count(*) FILTER (model = 'm2') AS m2 FROM tele GROUP BY 1")
def tele_pivot(spark, d):
    return _tele(spark, d).groupBy(F.to_date("timestamp").alias("day")).pivot("model", ["m0", "m1", "m2"]).count().na.fill(0)


@query("tele_lifecycle", """WITH TELE, g AS (SELECT suggestion_id, max(id) AS newest, max(id) FILTER (event_type = 'suggested') AS shown, min(id) FILTER (event_type <> 'suggested') AS other, count(*) AS n_events FROM tele GROUP BY suggestion_id)
  SELECT g.suggestion_id, newest, s.latency_ms, s.confidence, s.model, coalesce(o.event_type, 'ignored') AS outcome, n_events FROM g JOIN tele s ON s.id = g.shown LEFT JOIN tele o ON o.id = g.other""")
def tele_lifecycle(spark, d):
    return telemetry.lifecycle(_tele(spark, d))


@query("tele_outstanding", "WITH TELE, x AS (SELECT *, lead(event_type) OVER w AS nxt, lead(timestamp) OVER w AS ignored_at FROM tele WHERE event_type IN ('suggested', 'accepted', 'rejected') WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)) SELECT session_id, id AS suggested_id, ignored_at FROM x WHERE event_type = 'suggested' AND nxt = 'suggested'")
def tele_outstanding(spark, d):
    return telemetry.ignored(_tele(spark, d)).withColumn("ignored_at", F.col("ignored_at").cast("timestamp_ntz"))


@query("debounce", "WITH TELE, x AS (SELECT *, epoch(lead(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id)) - epoch(timestamp) AS wait FROM tele) SELECT id, session_id FROM x WHERE wait IS NULL OR wait >= 3600")
def debounce(spark, d):
    return telemetry.settled(_tele(spark, d), 3600).select("id", "session_id")


@query("stream_timeline", "WITH TELE SELECT date_trunc('hour', timestamp) AS bucket, model, event_type, count(*) AS n FROM tele GROUP BY 1, 2, 3")
def stream_timeline(spark, d):
    return run_timeline(spark, d).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_ignored", ORACLE["tele_outstanding"])
def stream_ignored(spark, d):
    return run_ignored(spark, d).withColumn("ignored_at", F.col("ignored_at").cast("timestamp_ntz"))


@query("tele_overall", "WITH TELE, m AS (SELECT model, count(*) AS n, count(*) FILTER (event_type = 'accepted') AS accepted FROM tele GROUP BY model) SELECT coalesce(model, 'all') AS model, CAST(sum(n) AS BIGINT) AS n, CAST(sum(accepted) AS BIGINT) AS accepted, count(*) AS models FROM m GROUP BY GROUPING SETS ((model), ())")
def tele_overall(spark, d):
    m = _tele(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "accepted").alias("accepted"))
    x = m.rollup("model").agg(F.sum("n").alias("n"), F.sum("accepted").alias("accepted"), F.count("*").alias("models"))
    return x.withColumn("model", F.coalesce("model", F.lit("all")))


@query("live_ignored", "WITH TELE, f AS (SELECT * FROM tele WHERE event_type IN ('suggested', 'accepted', 'rejected')), m AS (SELECT epoch_ms(max(timestamp)) - 2 * 86400000 AS mark FROM f), x AS (SELECT *, lead(event_type) OVER w AS nxt, lead(timestamp) OVER w AS ignored_at FROM f, m WHERE epoch_ms(timestamp) < mark WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)) SELECT session_id, id AS suggested_id, ignored_at FROM x WHERE event_type = 'suggested' AND nxt = 'suggested'")
def live_ignored(spark, d):
    return run_live_ignored(spark, d).withColumn("ignored_at", F.col("ignored_at").cast("timestamp_ntz"))


@query("live_batches")
def live_batches(spark, d):
    return run_live_batches(spark, d)
