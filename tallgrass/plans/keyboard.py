"""Registered queries: suggestion repair, keyboard candidates and simulations, comparisons of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.functions import suggestion, text
from tallgrass.operators import keyboard, metrics, tokens, telemetry
from tallgrass.plans.evaluation import PAIRS, _pairs, WORD_MODEL, word_model
from tallgrass.plans.registry import query
from tallgrass.sources.corpus import table

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_ALL = PAIRS.replace(" WHERE rank <= 5", "")


@query("suggestion_checks", r"""SELECT conv_id, turn, regexp_matches(text, '[^\x{00}-\x{FF}]') AS garbage, regexp_matches(text, '\d') AS digit, regexp_matches(trim(text), '^[.!,?;:()\[\]{}]+$') AS punctuation,
  CASE WHEN contains(text, '. ') THEN string_split(text, '. ')[1] WHEN contains(text, ',') THEN string_split(text, ',')[1] ELSE text END AS stopped,
  regexp_extract(text, '(\S*)\z', 1) AS current, regexp_replace(regexp_extract(text, '^(\S*)', 1), '[.!,?;:()\[\]{}]+$', '') AS first,
  trim(lower(regexp_extract(text, '(\S*)\z', 1)), '.!,?;:()[]{}"''') AS bare, greatest(1, length(text) // 4)::INTEGER AS tokens, CASE WHEN length(text) // 4 >= 40 THEN 'length' ELSE 'stop' END AS finish,
  substr(text, greatest(0, length(text) // 2 - 20) + 1, length(text) // 2 - greatest(0, length(text) // 2 - 20)) AS left_context, substr(text, length(text) // 2 + 1, 10) AS right_context,
  CASE WHEN turn % 2 = 0 THEN text ELSE 'fallback' END AS filled FROM conversations""")
def suggestion_checks(spark, d):
    x, s = F.col("text"), suggestion
    half = F.floor(F.length(x) / 2).cast("int")
    left, right = s.around_cursor(x, half, 20, 10)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", s.has_garbage(x).alias("garbage"), s.has_digit(x).alias("digit"), s.is_punctuation(x).alias("punctuation"), s.cut_at_stops(x, [". ", ","]).alias("stopped"),
        s.current_word(x).alias("current"), s.first_word(x).alias("first"), s.bare_word(s.current_word(x)).alias("bare"), s.token_estimate(x).alias("tokens"),
        s.finish_reason(F.floor(F.length(x) / 4), F.lit(40)).alias("finish"), left.alias("left_context"), right.alias("right_context"),
        s.first_filled(F.when(F.col("turn") % 2 == 0, x), F.lit("fallback")).alias("filled"),
    )


@query("confidence_gate", "WITH c AS (SELECT user_id, event_id, value / (value + 50) AS confidence FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (confidence >= 0.15) AS plugin, count(*) FILTER (confidence >= 0.2) AS editor FROM c GROUP BY user_id")
def confidence_gate(spark, d):
    c = table(spark, d, "events").select("user_id", (F.col("value") / (F.col("value") + 50)).alias("c"))
    return c.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 0.15).alias("plugin"), F.count_if(F.col("c") >= 0.2).alias("editor"))


@query("newest_generation", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) - 1 AS stale FROM events GROUP BY user_id")
def newest_generation(spark, d):
    """Stale responses go: the newest request of a session stands."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), (F.count("*") - 1).alias("stale"))


@query("cycled_alternatives", """WITH e AS (SELECT user_id, event_id, event_type <> 'click' AS fwd FROM events WHERE event_type IN ('view', 'click')), s AS (SELECT *, sum(CASE WHEN fwd THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e), d AS (SELECT *, k - least(0, min(k) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM s)
  SELECT user_id, event_id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth > 0 THEN max(CASE WHEN fwd THEN event_id END) OVER (PARTITION BY user_id, depth ORDER BY event_id) END AS shown FROM d""")
def cycled_alternatives(spark, d):
    """Which alternative is shown as a user asks for new ones (views) and walks back through the history (clicks)."""
    steps = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select("user_id", "event_id", (F.col("event_type") == "view").alias("forward"))
    return telemetry.cycled(steps, "user_id", "event_id").select("user_id", "event_id", "depth", "shown")


@query("digit_repair", f"""WITH t AS (SELECT conv_id, turn, {_W} AS w FROM conversations), p AS (SELECT conv_id, turn, list_transform(range(1, len(w) + 1), lambda i: {{'t': w[i], 'o': list_filter([w[i + 1], w[i + 2]], lambda x: x IS NOT NULL)}}) AS p FROM t),
  f AS (SELECT conv_id, turn, p, list_transform(p, lambda x: CASE WHEN regexp_matches(x.t, '\\d') THEN list_filter(x.o, lambda y: NOT regexp_matches(y, '\\d') AND y <> x.t)[1] ELSE x.t END) AS f FROM p),
  e AS (SELECT *, coalesce(list_min(list_filter(range(1, len(f) + 1), lambda i: f[i] IS NULL)) - 1, len(f)) AS n, list_min(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i].t, '\\d'))) - 1 AS c FROM f)
  SELECT conv_id, turn, array_to_string(f[1:n], ' ') AS repaired, CAST(CASE WHEN c < n THEN c ELSE -1 END AS INTEGER) AS first_swap FROM e""")
def digit_repair(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w"))
    path = F.transform("w", lambda x, i: F.struct(x.alias("text"), F.filter(F.array(F.get("w", i + 1), F.get("w", i + 2)), lambda y: y.isNotNull()).alias("others")))
    r = suggestion.repaired(path)
    return w.withColumn("r", r).select("conv_id", "turn", F.array_join("r.texts", " ").alias("repaired"), "r.first_swap")


_CTX = f"{_ALL}, ctx AS (SELECT DISTINCT prev, left(word, 2) AS typed FROM pairs), inside AS (SELECT c.prev, c.typed, g.word AS text, g.prob, false AS is_next FROM ctx c JOIN pred g ON g.prev = c.prev AND starts_with(g.word, c.typed) WHERE NOT regexp_matches(g.word, '\\d')), after AS (SELECT c.prev, c.typed, g.word AS text, g.prob, true AS is_next FROM ctx c JOIN pred g ON g.prev = c.typed WHERE c.typed <> '' AND NOT regexp_matches(g.word, '\\d')), u AS (SELECT prev, typed, is_next, text, max(prob) AS prob FROM (SELECT * FROM inside UNION ALL SELECT * FROM after) GROUP BY ALL), kc AS (SELECT *, row_number() OVER (PARTITION BY prev, typed ORDER BY prob DESC, is_next, text) AS rank FROM u WHERE NOT regexp_matches(text, '[^\\x{{00}}-\\x{{FF}}]'))"


@query("keyboard_candidates", f"WITH {_CTX} SELECT prev, typed, text, is_next, round(prob, 6) AS prob, CAST(rank AS INTEGER) AS rank FROM kc WHERE rank <= 5")
def keyboard_candidates(spark, d):
    p = _pairs(spark, d)
    followers = metrics.bigram_predictions(p, None).select("prev", "word", "prob")
    contexts = p.select("prev", F.left("word", F.lit(2)).alias("typed")).distinct().withColumn("id", F.lit(0))
    found = keyboard.keyboard_candidates(contexts, followers)
    return found.select("prev", "typed", "text", "is_next", F.round("prob", 6).alias("prob"), "rank")


@query("garbage_fallback", f"WITH {PAIRS}, s AS (SELECT conv_id, turn, text, turn % 3 = 0 AS bad, lower(regexp_extract(text, '(\\S*)\\z', 1)) AS prev FROM conversations) SELECT s.conv_id, s.turn, CASE WHEN bad THEN coalesce(g.word, '') ELSE s.text END AS shown, bad AS fell_back FROM s LEFT JOIN pred g ON s.bad AND g.prev = s.prev AND g.rank = 1")
def garbage_fallback(spark, d):
    """Where a suggestion is garbage (here every third turn) the keyboard's best candidate is shown."""
    s = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 3 == 0).alias("bad"), F.lower(suggestion.current_word(F.col("text"))).alias("last"))
    top = metrics.bigram_predictions(_pairs(spark, d), 1).select(F.col("prev").alias("last"), "word")
    good, bad = s.filter("NOT bad"), s.filter("bad").join(top, "last", "left")
    return good.select("conv_id", "turn", F.col("text").alias("shown"), F.lit(False).alias("fell_back")).unionByName(bad.select("conv_id", "turn", F.coalesce("word", F.lit("")).alias("shown"), F.lit(True).alias("fell_back")))


@query("sticky_merge", f"""WITH {PAIRS}, po AS (SELECT prev, rank AS place, word AS text, prob FROM pred WHERE rank <= 3), fr AS (SELECT prev, rank AS place, word AS text, prob / 2 AS prob FROM pred WHERE rank >= 2),
  al AS (SELECT *, true AS sticky FROM po WHERE starts_with(lower(text), 't')), nw AS (SELECT *, false AS sticky FROM fr WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.prev = fr.prev AND al.text = fr.text)),
  r AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY prob + CASE WHEN sticky THEN 0.1 ELSE 0 END DESC, sticky DESC, place) AS rank FROM (SELECT * FROM al UNION ALL SELECT * FROM nw))
  SELECT prev, text, sticky, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def sticky_merge(spark, d):
    p = metrics.bigram_predictions(_pairs(spark, d)).select("prev", F.col("rank").alias("at"), F.col("word").alias("text"), "prob")
    found = keyboard.merged(p.filter("at <= 3"), p.filter("at >= 2").withColumn("prob", F.col("prob") / 2), ["prev"], F.lit("t"))
    return found.select("prev", "text", "sticky", "rank")


@query("chip_acceptance", r"""WITH c AS (SELECT conv_id, turn, text AS editor, length(text) - length(text) // 5 AS cursor, CASE turn % 3 WHEN 0 THEN ' .' WHEN 1 THEN 'word' ELSE 'next' END AS chip, turn % 3 = 2 AS nx FROM conversations),
  h AS (SELECT *, left(editor, cursor) AS l, substr(editor, cursor + 1) AS r FROM c),
  p AS (SELECT *, CASE WHEN nx THEN l WHEN turn % 3 = 0 THEN CASE WHEN ends_with(l, ' ') THEN left(l, length(l) - 1) ELSE l END ELSE regexp_replace(l, '\S*\z', '') END AS head, CASE WHEN nx THEN ' next ' WHEN turn % 3 = 0 THEN '. ' ELSE 'word ' END AS put FROM h)
  SELECT conv_id, turn, head || put || r AS editor, CAST(length(head) + length(put) AS INTEGER) AS cursor FROM p""")
def chip_acceptance(spark, d):
    kind, x = F.col("turn") % 3, F.col("text")
    chip = F.when(kind == 0, " .").when(kind == 1, "word").otherwise("next")
    r = suggestion.accepted(x, F.length(x) - F.floor(F.length(x) / 5).cast("int"), chip, kind == 2)
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.editor", "r.cursor")


def _typing_tests(spark, d):
    """Benchmark items cut in the middle; the predictor has seen the conversations and not the items."""
    w = text.words(F.col("text"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("test_id"), w.alias("w")).filter("size(w) > 1")
    half = F.expr("size(w) div 2")
    return b.select("test_id", F.array_join(F.slice("w", F.lit(1), half), " ").alias("prompt"), F.array_join(F.slice("w", half + 1, F.size("w")), " ").alias("target"))


def _typed(spark, d):
    tests = _typing_tests(spark, d)
    followers = metrics.bigram_predictions(_pairs(spark, d), None).select("prev", "word", "prob")
    return keyboard.simulate(tests, keyboard.keyboard_candidates(keyboard.contexts_of(tests), followers))


@query("keyboard_simulation")
def keyboard_simulation(spark, d):
    r = _typed(spark, d)
    return r.select("test_id", "csr", "acceptance_rate", "top1", "top3", "top5", "avg_prefix", "avg_confidence", "keystrokes", "taps", "n_words", "total_chars", F.size("events").alias("n_events"))


@query("keyboard_summary")
def keyboard_summary(spark, d):
    return keyboard.summary(_typed(spark, d).withColumn("set", F.concat(F.lit("s"), (F.col("test_id") % 3).cast("string"))), "set")


@query("typing_trace")
def typing_trace(spark, d):
    """A simulation's events, one a row."""
    e = _typed(spark, d).select("test_id", F.posexplode("events").alias("step", "e"))
    return e.select("test_id", "step", "e.type", "e.prefix", "e.char", "e.accepted", "e.method", "e.prob", "e.prefix_len")


@query("retroactive_topk")
def retroactive_topk(spark, d):
    """Replayed traces beside the stored counts."""
    r = _typed(spark, d)
    target = _typing_tests(spark, d).select("test_id", text.words(F.col("target")).alias("words"))
    again = keyboard.replayed(r.join(target, "test_id").select("test_id", "words", "events"))
    stored = r.select("test_id", *[F.round(F.col(k) * F.col("n_words")).cast("int").alias(f"stored_{k}") for k in ("top1", "top3", "top5")], F.transform("completed", lambda c: F.when(c["method"] == "manual", "manual").otherwise("completion")).alias("stored"))
    x = again.join(stored, "test_id")
    return x.select("test_id", "top1", "top3", "top5", "n_words", "stored_top1", "stored_top3", "stored_top5", (F.col("methods") == F.col("stored")).alias("same_words"))


# --- comparisons -----------------------------------------------------------------------------------


@query("plausible_hits", f"""WITH {PAIRS}, t AS (SELECT prev, list_sort(list_distinct(list(word))) AS among FROM pairs WHERE turn % 2 = 0 GROUP BY prev), x AS (SELECT g.prev, g.rank, trim(lower(g.word), '▁<>') AS w, among FROM pred g JOIN t USING (prev)),
  h AS (SELECT prev, rank, w <> '' AND len(list_filter(among, lambda p: w = lower(p) OR (length(w) >= 2 AND (starts_with(lower(p), w) OR starts_with(w, lower(p)))))) > 0 AS hit FROM x) SELECT count(DISTINCT prev) AS prompts, count(*) FILTER (rank = 1 AND hit) AS top1, count(DISTINCT prev) FILTER (hit) AS top5 FROM h""")
def plausible_hits(spark, d):
    p = _pairs(spark, d)
    among = p.filter("turn % 2 = 0").groupBy("prev").agg(F.array_sort(F.collect_set("word")).alias("among"))
    h = metrics.bigram_predictions(p).join(among, "prev").withColumn("hit", suggestion.plausible(F.col("word"), F.col("among")))
    return h.agg(F.count_distinct("prev").alias("prompts"), F.count_if((F.col("rank") == 1) & F.col("hit")).alias("top1"), F.count_distinct(F.when(F.col("hit"), F.col("prev"))).alias("top5"))


@query("morphacc_summary", f"""WITH {PAIRS}, t AS (SELECT prev, list_distinct(list(left(word, 2))) AS valid FROM pairs WHERE turn % 2 = 0 GROUP BY prev), h AS (SELECT prev, min(CASE WHEN len(list_filter(valid, lambda s: starts_with(g.word, s))) > 0 THEN g.rank END) AS first_rank, sum(CASE WHEN len(list_filter(valid, lambda s: starts_with(g.word, s))) > 0 THEN g.prob ELSE 0 END) AS mass FROM t JOIN pred g USING (prev) GROUP BY prev)
  SELECT count(*) AS tests, count(first_rank) AS hits, round(count(first_rank) / count(*), 4) AS morphacc, round(avg(round(mass, 4)), 4) AS mean_mass, round(avg(first_rank), 4) AS mean_rank FROM h""")
def morphacc_summary(spark, d):
    p = _pairs(spark, d)
    valid = p.filter("turn % 2 = 0").groupBy("prev").agg(F.collect_set(F.left("word", F.lit(2))).alias("valid"))
    x = metrics.bigram_predictions(p).join(valid, "prev").withColumn("hit", F.exists("valid", lambda s: F.col("word").startswith(s)))
    h = x.groupBy("prev").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.round(F.sum(F.when(F.col("hit"), F.col("prob")).otherwise(0.0)), 4).alias("mass"))
    return h.agg(F.count("*").alias("tests"), F.count("first").alias("hits"), F.round(F.count("first") / F.count("*"), 4).alias("morphacc"), F.round(F.avg("mass"), 4).alias("mean_mass"), F.round(F.avg("first"), 4).alias("mean_rank"))


_PARA = f"""{_ALL}, roots AS (SELECT DISTINCT prev FROM pred WHERE length(prev) > 6), k AS (SELECT unnest(['th', 'er', 'an', 'in']) AS suffix), b AS (SELECT r.prev, k.suffix, max(g.prob) AS best FROM roots r CROSS JOIN k LEFT JOIN pred g ON g.prev = r.prev AND starts_with(g.word, k.suffix) GROUP BY ALL),
  r AS (SELECT prev, suffix, CASE WHEN best IS NOT NULL THEN 1 + (SELECT count(*) FROM pred g WHERE g.prev = b.prev AND g.prob > b.best) END AS rank FROM b)"""


@query("paradigm_summary", f"WITH {_PARA} SELECT coalesce(suffix, 'all') AS suffix, count(*) AS n, count(*) FILTER (rank <= 1) AS hit1, count(*) FILTER (rank <= 3) AS hit3, count(*) FILTER (rank <= 5) AS hit5, round(avg(rank), 4) AS mean_rank FROM r GROUP BY GROUPING SETS ((suffix), ())")
def paradigm_summary(spark, d):
    pred = metrics.bigram_predictions(_pairs(spark, d), None).filter(F.length("prev") > 6)
    ranked = pred.withColumn("r", F.rank().over(Window.partitionBy("prev").orderBy(F.desc("prob"))))
    cases = F.explode(F.array(*map(F.lit, ("th", "er", "an", "in")))).alias("suffix")  # roots x cases: a literal list, no join
    x = ranked.select("prev", "word", "r", cases).groupBy("prev", "suffix").agg(F.min(F.when(F.expr("startswith(word, suffix)"), F.col("r"))).alias("rank"))
    at = lambda k: F.count_if(F.col("rank") <= k).alias(f"hit{k}")
    return x.rollup("suffix").agg(F.count("*").alias("n"), at(1), at(3), at(5), F.round(F.avg("rank"), 4).alias("mean_rank")).withColumn("suffix", F.coalesce("suffix", F.lit("all")))


@query("filter_gap", f"""WITH {PAIRS}, b AS (SELECT p.word AS target, coalesce(g.word, '') AS raw, CASE WHEN regexp_matches(coalesce(g.word, ''), '\\p{{L}}') THEN g.word ELSE '' END AS filtered FROM pairs p LEFT JOIN pred g ON p.prev = g.prev AND g.rank = 1),
  m AS (SELECT avg(CASE WHEN raw = target THEN 1.0 ELSE 0 END) AS raw, avg(CASE WHEN filtered = target THEN 1.0 ELSE 0 END) AS filtered FROM b) SELECT round(raw, 6) AS raw, round(filtered, 6) AS filtered, round(abs(raw - filtered), 6) AS gap FROM m""")
def filter_gap(spark, d):
    """The same measure with and without the filter, side by side, and their distance."""
    p = _pairs(spark, d)
    top = metrics.bigram_predictions(p, 1).select("prev", F.col("word").alias("guess"))
    x = p.join(top, "prev", "left").select("word", F.coalesce("guess", F.lit("")).alias("guess"))
    modes = F.inline(F.array(F.struct(F.lit("raw").alias("mode"), F.col("guess").alias("g")), F.struct(F.lit("filtered").alias("mode"), F.when(F.col("guess").rlike(r"\p{L}"), F.col("guess")).otherwise("").alias("g"))))
    m = x.select("word", modes).groupBy().pivot("mode", ["raw", "filtered"]).agg(F.avg((F.col("g") == F.col("word")).cast("double")))
    return m.select(F.round("raw", 6).alias("raw"), F.round("filtered", 6).alias("filtered"), F.round(F.abs(F.col("raw") - F.col("filtered")), 6).alias("gap"))


_MODELS = "md AS (SELECT conv_id, turn, 'm' || (turn % 3) AS model, length(text) AS score, text FROM conversations)"


@query("head_to_head", f"WITH {_MODELS}, r AS (SELECT conv_id, model, score, row_number() OVER (PARTITION BY conv_id, model ORDER BY turn) AS pos FROM md) SELECT conv_id, CAST(pos AS INTEGER) AS pos, max(score) FILTER (model = 'm0') AS m0, max(score) FILTER (model = 'm1') AS m1, max(score) FILTER (model = 'm2') AS m2 FROM r GROUP BY 1, 2")
def head_to_head(spark, d):
    """Models side by side by position."""
    m = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("m"), (F.col("turn") % 3).cast("string")).alias("model"), F.length("text").cast("long").alias("score"))
    r = m.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "model").orderBy("turn")))
    return r.groupBy("conv_id", "pos").pivot("model", ["m0", "m1", "m2"]).agg(F.max("score"))


@query("appendix_rows", "WITH x AS (SELECT conv_id, turn, text, string_split(text, ' ')[2] AS middle FROM conversations) SELECT conv_id, turn, CASE WHEN middle IS NULL OR middle = '' THEN text ELSE left(text, instr(text, middle) - 1) || '**' || middle || '**' || substr(text, instr(text, middle) + length(middle)) END AS shown FROM x")
def appendix_rows(spark, d):
    """Bold at a middle's first occurrence."""
    x = table(spark, d, "conversations").withColumn("middle", F.get(F.split("text", " "), F.lit(1)))
    at = F.expr("instr(text, middle)")
    bold = F.concat(F.expr("left(text, instr(text, middle) - 1)"), F.lit("**"), F.col("middle"), F.lit("**"), F.substring("text", at + F.length("middle"), F.length("text")))
    return x.select("conv_id", "turn", F.when(F.col("middle").isNull() | (F.col("middle") == ""), F.col("text")).otherwise(bold).alias("shown"))


_STEPS = "st AS (SELECT conv_id % 3 AS step, count(*) AS n, avg(length(text)) AS score FROM conversations GROUP BY 1)"


@query("checkpoint_trend", f"WITH {_STEPS} SELECT round(max(score) FILTER (step = 0), 6) AS first, round(max(score) FILTER (step = 1), 6) AS second, round(max(score) FILTER (step = 2), 6) AS third, CASE WHEN max(score) FILTER (step = 2) > max(score) FILTER (step = 0) THEN '↑' WHEN max(score) FILTER (step = 2) < max(score) FILTER (step = 0) THEN '↓' ELSE '→' END AS trend FROM st")
def checkpoint_trend(spark, d):
    s = table(spark, d, "conversations").withColumn("step", F.col("conv_id") % 3).groupBy("step").agg(F.avg(F.length("text")).alias("score"))
    return metrics.trend(s, "step", "score").select(*[F.round(c, 6).alias(c) for c in ("first", "second", "third")], "trend")


@query("checkpoint_compare", "WITH x AS (SELECT 'step' || (conv_id % 3) AS checkpoint, conv_id, turn, length(text) AS score, CASE WHEN turn % 2 = 0 THEN 'completion' ELSE 'manual' END AS method FROM conversations) SELECT checkpoint, count(*) AS n, round(avg(score), 6) AS mean, round(avg(score) - 1.96 * stddev_samp(score) / sqrt(count(*)), 6) AS lo, round(avg(score) + 1.96 * stddev_samp(score) / sqrt(count(*)), 6) AS hi, count(*) FILTER (method = 'completion') AS completion, count(*) FILTER (method = 'manual') AS manual FROM x GROUP BY checkpoint")
def checkpoint_compare(spark, d):
    x = table(spark, d, "conversations").withColumn("checkpoint", F.concat(F.lit("step"), (F.col("conv_id") % 3).cast("string"))).withColumn("score", F.length("text"))
    return metrics.compared(x.withColumn("method", F.when(F.col("turn") % 2 == 0, "completion").otherwise("manual")), "checkpoint", "score")


@query("rank_disagreements", f"WITH {PAIRS}, c AS (SELECT DISTINCT prev, word FROM pairs), r AS (SELECT c.prev, c.word, coalesce(g.rank, -1) AS r0, coalesce(CASE WHEN g.rank % 2 = 0 THEN g.rank - 1 ELSE g.rank END, -1) AS r1 FROM c LEFT JOIN pred g USING (prev, word)) SELECT prev, word, CAST(r0 AS INTEGER) AS r0, CAST(r1 AS INTEGER) AS r1 FROM r WHERE r0 <> r1")
def rank_disagreements(spark, d):
    """Cases to which two checkpoints (the second ranks in pairs) give different ranks."""
    p = _pairs(spark, d)
    ranks = metrics.bigram_predictions(p).select("prev", "word", "rank")
    both = F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("rank").alias("rank")), F.struct(F.lit(1).alias("step"), F.when(F.col("rank") % 2 == 0, F.col("rank") - 1).otherwise(F.col("rank")).alias("rank"))))
    rows = p.select("prev", "word").distinct().join(ranks, ["prev", "word"], "left").select("prev", "word", both.alias("x")).select("prev", "word", "x.*")
    return metrics.disagreements(rows, ["prev", "word"])


@query("replay_summary", f"WITH {PAIRS}, a AS (SELECT DISTINCT prev, word FROM pairs), r AS (SELECT a.prev, a.word, g.rank - 1 AS rank, g.prob FROM a LEFT JOIN pred g USING (prev, word)) SELECT count(*) AS n, round(100.0 * count(*) FILTER (rank = 0) / count(*), 4) AS top1, round(100.0 * count(*) FILTER (rank <= 2) / count(*), 4) AS top3, round(100.0 * count(rank) / count(*), 4) AS topk, round(avg(prob), 6) AS mean_prob FROM r")
def replay_summary(spark, d):
    p = _pairs(spark, d)
    r = p.select("prev", "word").distinct().join(metrics.bigram_predictions(p), ["prev", "word"], "left")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return r.agg(F.count("*").alias("n"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 3).alias("top3"), share(F.col("rank").isNotNull()).alias("topk"), F.round(F.avg("prob"), 6).alias("mean_prob"))


@query("language_logprob", f"WITH {WORD_MODEL}, m AS (SELECT doc_id, any_value(lang) AS lang, avg(lp) AS m FROM u JOIN lp USING (w) GROUP BY doc_id) SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(m), 6) AS mean_logprob FROM m GROUP BY GROUPING SETS ((lang), ())")
def language_logprob(spark, d):
    """Means of the samples' mean log-probabilities by language, under the counted word model."""
    words, model = word_model(spark, d)
    m = words.groupBy("doc_id", "lang", "w").agg(F.count("*").alias("k")).join(model, "w").groupBy("doc_id").agg(F.first("lang").alias("lang"), (F.sum(F.col("k") * F.col("lp")) / F.sum("k")).alias("m"))
    return m.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean_logprob")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("sample_grid", "WITH p AS (SELECT item_id, text FROM benchmark) SELECT item_id, model, CAST(sample AS INTEGER) AS sample, CASE WHEN (item_id + sample) % 5 = 0 THEN 0.0 ELSE round(length(text) / 1000.0, 6) END AS confidence FROM p CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS model) CROSS JOIN (SELECT unnest(range(3)) AS sample)")
def sample_grid(spark, d):
    """A row a prompt, model and sample, those in error with confidence 0; models and samples are literal lists."""
    x = table(spark, d, "benchmark").select("item_id", F.length("text").alias("n"), F.explode(F.array(*map(F.lit, "abc"))).alias("model"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample"))
    return x.select("item_id", "model", "sample", F.when((F.col("item_id") + F.col("sample")) % 5 == 0, 0.0).otherwise(F.round(F.col("n") / 1000.0, 6)).alias("confidence"))


@query("benchmark_means", "WITH r AS (SELECT event_type, user_id % 5 AS prompt, value, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type, user_id % 5) AS n FROM events), m AS (SELECT event_type, prompt, avg(value) AS mean, max(CASE WHEN k = CAST(floor(0.95 * n) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY 1, 2) SELECT event_type, count(*) AS prompts, round(avg(mean), 6) AS mean_of_means, round(max(mean), 6) AS peak, round(avg(p95), 6) AS p95 FROM m GROUP BY event_type")
def benchmark_means(spark, d):
    """Means by prompt first; p95 is the element at int(0.95 n)."""
    return metrics.mean_of_means(table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("prompt"), "value"), "event_type", "prompt", "value")


@query("throughput", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id) / (1 + epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS rate, round(exp(least(value, 20)), 4) AS capped_ppl FROM events")
def throughput(spark, d):
    """Tokens a second since the start, and perplexity with a cap."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w) / (1 + at - F.min(at).over(w)), 6).alias("rate"), F.round(F.exp(F.least("value", F.lit(20))), 4).alias("capped_ppl"))


@query("validation_mean", "SELECT user_id, round(avg(value), 6) AS loss FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 100 GROUP BY user_id")
def validation_mean(spark, d):
    """The mean over the first hundred batches of each run, as evaluation takes it."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "value", k.alias("k")).filter("k <= 100").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("loss"))


@query("chosen_path", "SELECT user_id, arg_min(event_id, [CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, -event_id]) AS event_id FROM events GROUP BY user_id")
def chosen_path(spark, d):
    """The newest candidate of the first kind that there is."""
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(order.alias("p"), (-F.col("event_id")).alias("k"))).alias("event_id"))


_IDS = "list_transform({w}, lambda x: ('0x' || substr(md5(x), 1, 6))::BIGINT % 3990 + 5)".format(w=_W)


@query("array_checks", f"WITH i AS (SELECT conv_id, turn, {_IDS} AS ids FROM conversations) SELECT conv_id, turn, len(ids) > 4 AND len(list_distinct(ids)) < 0.4 * len(ids) AS repetitive, CAST(coalesce(list_position(ids, ids[3]), 0) AS INTEGER) - 1 AS place, CASE WHEN list_contains(ids, ids[4]) THEN len(ids[1:list_position(ids, ids[4]) - 1]) ELSE len(ids) END AS kept FROM i")
def array_checks(spark, d):
    """Repetition, the first place of a part, and the cut before a stop id."""
    i = table(spark, d, "conversations").select("conv_id", "turn", tokens.hashed_ids(text.words(F.col("text"))).alias("ids"))
    third, fourth = F.get("ids", F.lit(2)), F.get("ids", F.lit(3))
    place = F.when(third.isNull(), -1).otherwise(tokens.find_array(F.col("ids"), F.array(third)))
    kept = F.when(fourth.isNull(), F.size("ids")).otherwise(F.size(metrics.cut_at_stop(F.col("ids"), fourth)))
    return i.select("conv_id", "turn", metrics.is_repetitive(F.col("ids")).alias("repetitive"), place.alias("place"), kept.cast("long").alias("kept"))


@query("softmax_topk", "WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM l), p AS (SELECT vec_id, list_transform(x, lambda v: v / list_sum(x)) AS p FROM s), u AS (SELECT vec_id, unnest(range(len(p))) AS id, unnest(p) AS prob FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, id) AS rank FROM u) SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(id AS INTEGER) AS id, round(prob, 6) AS prob FROM r WHERE rank <= 3")
def softmax_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", metrics.softmax_top(F.col("embedding").cast("array<double>"), 3).alias("top"))
    return e.select("vec_id", F.posexplode("top").alias("k", "t")).select("vec_id", (F.col("k") + 1).alias("rank"), "t.id", F.round("t.prob", 6).alias("prob"))
