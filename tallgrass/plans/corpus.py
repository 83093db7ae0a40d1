"""Registered queries: audit, cleaning, extraction, evaluation sets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import corpus, tokens
from tallgrass.plans.registry import query
from tallgrass.sources.corpus import exclude_sources, lines, table, with_global_index


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


def _lines(spark, d) -> DataFrame:
    return lines(table(spark, d, "documents"))


@query("audit_line_class", r"""WITH LINES SELECT source, CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 'blank'
  WHEN regexp_full_match(line, '.+: \d[\d,]* lines [→\-]+ sampling \d[\d,]* lines') THEN 'header' ELSE 'content' END AS class, count(*) AS n FROM lines GROUP BY 1, 2""")
def audit_line_class(spark, d):
    return _lines(spark, d).groupBy("source", corpus.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


_LANG = f"""w AS (SELECT *, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_''-]+') AS w FROM lines),
 c AS (SELECT *, len(list_filter(w, lambda x: x IN {_in(corpus.EU)})) AS a, len(list_filter(w, lambda x: x IN {_in(corpus.ES)})) AS b FROM w),
 f AS (SELECT *, CASE WHEN a >= 2 AND b = 0 THEN 'clean' WHEN a >= 1 AND b >= 1 THEN 'mixed' WHEN b >= 2 AND a = 0 THEN 'non_eu' ELSE 'uncertain' END AS label FROM c)"""


@query("audit_lang_flags", f"""WITH LINES, {_LANG} SELECT lang, label, count(*) AS n_lines, CAST(sum(a) AS BIGINT) AS n_first, CAST(sum(b) AS BIGINT) AS n_second,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 3) AS pct FROM f GROUP BY lang, label""")
def audit_lang_flags(spark, d):
    found = corpus.with_language(_lines(spark, d)).groupBy("lang", "label").agg(F.count("*").alias("n_lines"), F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))
    return found.withColumn("pct", corpus.pct(F.col("n_lines"), F.sum("n_lines").over(Window.partitionBy("lang"))))


_FLAGS = ", ".join(f"CAST(sum(CASE WHEN regexp_matches(line, '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, p in corpus.ARTEFACTS.items())


@query("audit_artifacts", f"""WITH LINES SELECT source, count(*) AS n, {_FLAGS}, CAST(sum(CASE WHEN length(line) > 280 THEN 1 ELSE 0 END) AS BIGINT) AS long_280,
  CAST(sum(CASE WHEN length(line) > 512 THEN 1 ELSE 0 END) AS BIGINT) AS long_512,
  CAST(sum(CASE WHEN len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) < 2 THEN 1 ELSE 0 END) AS BIGINT) AS lt2_words FROM lines GROUP BY source""")
def audit_artifacts(spark, d):
    x = corpus.with_artefacts(_lines(spark, d))
    return x.groupBy("source").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(k)).alias(k) for k in corpus.ARTEFACTS], F.count_if(F.length("line") > 280).alias("long_280"),
        F.count_if(F.length("line") > 512).alias("long_512"), F.count_if(F.size(text.words(F.col("line"))) < 2).alias("lt2_words"),
    )


@query("audit_examples_topn", f"""WITH LINES, f AS (SELECT doc_id, line_no, line, unnest(['email', 'punct_run', 'long_512']) AS flag,
  unnest([regexp_matches(line, '{corpus.ARTEFACTS["email"]}'), regexp_matches(line, '{corpus.ARTEFACTS["punct_run"]}'), length(line) > 512]) AS hit FROM lines),
  r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id, line_no) AS rk FROM f WHERE hit) SELECT flag, CAST(rk AS INTEGER) AS rk, doc_id, CAST(line_no AS INTEGER) AS line_no, left(line, 240) AS line FROM r WHERE rk <= 3""")
def audit_examples_topn(spark, d):
    x = corpus.with_artefacts(_lines(spark, d)).withColumn("long_512", F.length("line") > 512)
    x = x.select("doc_id", "line_no", "line", F.expr("stack(3, 'email', email, 'punct_run', punct_run, 'long_512', long_512) AS (flag, hit)")).filter("hit")
    r = x.withColumn("rk", F.row_number().over(Window.partitionBy("flag").orderBy("doc_id", "line_no"))).filter("rk <= 3")
    return r.select("flag", "rk", "doc_id", "line_no", F.left("line", F.lit(240)).alias("line"))


_DUP = """c AS (SELECT source, line, count(*) AS c FROM lines GROUP BY source, line),
 s AS (SELECT source, CAST(sum(c) AS BIGINT) AS lines, count(*) AS distinct_lines, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS dup_lines FROM c GROUP BY source)"""


@query("audit_dup_clusters", f"WITH LINES, {_DUP} SELECT *, round(100.0 * dup_lines / lines, 3) AS dup_pct FROM s")
def audit_dup_clusters(spark, d):
    return corpus.duplicate_clusters(_lines(spark, d), ["source"])


@query("audit_dup_top", "WITH LINES SELECT left(line, 240) AS line, count(*) AS c FROM lines GROUP BY lines.line HAVING count(*) > 1 ORDER BY c DESC, min(doc_id * 100000 + line_no) LIMIT 10")
def audit_dup_top(spark, d):
    x = _lines(spark, d).groupBy("line").agg(F.count("*").alias("c"), F.min(F.col("doc_id") * 100000 + F.col("line_no")).alias("at")).filter("c > 1")
    return x.orderBy(F.desc("c"), "at").limit(10).select(F.left("line", F.lit(240)).alias("line"), "c")


@query("audit_length_summary", """WITH LINES, s AS (SELECT source, length(line) AS len, row_number() OVER (PARTITION BY source ORDER BY length(line)) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM lines)
  SELECT source, any_value(n) AS n, round(avg(len), 2) AS avg_len, median(len) AS median_len, max(CASE WHEN k = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN len END) AS p95_len, max(len) AS max_len FROM s GROUP BY source""")
def audit_length_summary(spark, d):
    return corpus.length_summary(_lines(spark, d), ["source"]).withColumn("p95_len", F.col("p95_len").cast("long")).withColumn("max_len", F.col("max_len").cast("long"))


@query("audit_rollup", f"WITH LINES, {_DUP} SELECT coalesce(source, 'all') AS source, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(dup_lines) AS BIGINT) AS dup_lines, round(100.0 * sum(dup_lines) / sum(lines), 3) AS dup_pct FROM s GROUP BY GROUPING SETS ((source), ())")
def audit_rollup(spark, d):
    x = corpus.duplicate_clusters(_lines(spark, d), ["source"]).rollup("source").agg(F.sum("lines").alias("lines"), F.sum("dup_lines").alias("dup_lines"))
    return x.select(F.coalesce("source", F.lit("all")).alias("source"), "lines", "dup_lines", corpus.pct(F.col("dup_lines"), F.col("lines")).alias("dup_pct"))


@query("audit_risk_rank", f"""WITH LINES, {_DUP}, p AS (SELECT source, sum(CASE WHEN regexp_matches(line, '{corpus.ARTEFACTS["punct_run"]}') THEN 1 ELSE 0 END) AS p,
  sum(CASE WHEN regexp_matches(line, '{corpus.ARTEFACTS["html"]}') THEN 1 ELSE 0 END) AS h FROM lines GROUP BY source)
  SELECT source, round(100.0 * h / lines, 3) + round(100.0 * p / lines, 3) + round(100.0 * dup_lines / lines, 3) AS risk FROM s JOIN p USING (source) ORDER BY risk DESC, source LIMIT 10""")
def audit_risk_rank(spark, d):
    x = corpus.with_artefacts(_lines(spark, d))
    flags = x.groupBy("source").agg(F.count_if("punct_run").alias("p"), F.count_if("html").alias("h"))
    both = corpus.duplicate_clusters(x, ["source"]).join(flags, "source")
    risk = corpus.pct(F.col("h"), F.col("lines")) + corpus.pct(F.col("p"), F.col("lines")) + F.col("dup_pct")
    return both.select("source", risk.alias("risk")).orderBy(F.desc("risk"), "source").limit(10)


def _chain(x: str, *subs: tuple[str, str]) -> str:
    for p, to in subs:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_RUNS = [(f"[{c}]{{3,}}", c * 2) for c in "!?¿¡"] + [(f"[{c}]{{2,}}", c) for c in ",;:&"] + [("-{3,}", "--"), ("_{3,}", "__"), (r"\.{4,}", "..."), ("—{3,}", "—"), ("–{3,}", "–")]
_QUICK = _chain("line", (r"https?://\S+", ""), (r"\S+@\S+\.\S+", ""), (r"@[\p{L}\p{N}_]+", ""), (r"#([\p{L}\p{N}_]{7,})", r"\1"), (r"#[\p{L}\p{N}_]+", ""), *_RUNS, (" {2,}", " "), (r"^\s+|\s+$", ""))
_NW = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


@query("clean_quick_lines", f"WITH LINES, q AS (SELECT doc_id, line_no, {_QUICK} AS c FROM lines) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN {_NW('c')} < 2 THEN '' ELSE c END AS cleaned FROM q")
def clean_quick_lines(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.quick_clean(F.col("line")).alias("cleaned"))


_SHARE = "length(regexp_replace(line, '[^0-9]', '', 'g')) / greatest(length(line), 1)"
_TOKS = "list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')"


@query("digit_rules", f"""WITH LINES, t AS (SELECT source, line, {_TOKS} AS w FROM lines),
  r AS (SELECT source, CASE WHEN regexp_matches(line, '\\d{{7,}}') THEN 'digit_long_run' WHEN len(list_filter(w, lambda x: regexp_matches(x, '\\d'))) / greatest(len(w), 1) > 0.4 THEN 'digit_heavy_tokens'
  WHEN {_SHARE} > 0.5 THEN 'digit_heavy_chars' ELSE 'pass' END AS reason FROM t) SELECT source, reason, count(*) AS n FROM r GROUP BY 1, 2""")
def digit_rules(spark, d):
    x = F.col("line")
    reason = F.when(x.rlike(r"\d{7,}"), "digit_long_run").when(text.digit_token_ratio(x) > 0.4, "digit_heavy_tokens").when(text.digit_char_ratio(x) > 0.5, "digit_heavy_chars").otherwise("pass")
    return _lines(spark, d).groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


_B = r"(^|[^\p{L}\p{N}_])"
_PHASE2 = _chain("line", (r"(?i)https?://\S+", ""), (r"\S+@\S+\.\S+", ""), (_B + r"@[\p{L}\p{N}_]+", r"\1"), (_B + r"#([\p{L}\p{N}_]{7,})", r"\1\2"), (_B + r"#[\p{L}\p{N}_]+", r"\1"), *_RUNS)
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PHASE2 = f"replace({_PHASE2}, '{_name}', '{_sign}')"
_PHASE2 = _chain(_PHASE2, ("<[^>]*>", ""), (" {2,}", " "), (r"^\s+|\s+$", ""))
_LEFT = _chain("x", (text.DECREE, ""), (" {2,}", " "), (r"^\s+|\s+$", ""), (r"^[,;:.\s]+", ""), (r"[,;:]\s*[.]", "."), (r"\s+[.]\s*$", "."), (r"\s+[,;:]\s*$", ""), (r"^\s+|\s+$", ""))
_XS = "length(regexp_replace(x, '[^0-9]', '', 'g')) / greatest(length(x), 1)"
_XT = _TOKS.replace("(line,", "(x,")
_TAGGED = f"""p2 AS (SELECT *, {_PHASE2} AS x FROM lines), l2 AS (SELECT *, {_LEFT} AS cleaned, {_XT} AS w, {_XS} AS share FROM p2),
  a2 AS (SELECT *, len(list_filter(w, lambda t: 2 * length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) > length(t))) AS alpha FROM l2),
  t2 AS (SELECT *, CASE WHEN x = '' THEN 'discard' WHEN (share > 0.55 AND alpha <= 1) OR (share > 0.5 AND alpha = 0) THEN 'digit_pure' WHEN regexp_matches(x, '{text.ORPHAN_DATE}') THEN 'digit_orphan_date'
   WHEN regexp_matches(x, '\\d{{7,}}') THEN 'digit_long_run' WHEN len(list_filter(w, lambda t: regexp_matches(t, '\\d'))) / greatest(len(w), 1) > 0.4 THEN 'digit_heavy_tokens' WHEN share > 0.5 THEN 'digit_heavy_chars'
   WHEN {_NW('cleaned')} < 2 THEN 'digit_decree_stripped' WHEN regexp_matches(cleaned, '^\\p{{Ll}}') AND NOT regexp_matches(cleaned, '[.!?"»]$') AND (length(cleaned) < 50 OR regexp_matches(cleaned, '[,;-]$')) THEN 'orphan_fragment'
   WHEN length(cleaned) > 2048 THEN 'discard' WHEN length(cleaned) > 512 THEN 'warn' END AS tag FROM a2)"""


@query("clean_reason_counts", f"WITH LINES, {_TAGGED} SELECT source, coalesce(tag, 'kept') AS tag, count(*) AS n FROM t2 GROUP BY 1, 2")
def clean_reason_counts(spark, d):
    return corpus.phase2(_lines(spark, d)).groupBy("source", F.coalesce("tag", F.lit("kept")).alias("tag")).agg(F.count("*").alias("n"))


@query("clean_dry_run", f"WITH LINES, {_TAGGED} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(tag, 'keep') AS tag, CASE WHEN tag IS NULL OR tag = 'warn' THEN left(cleaned, 240) ELSE '<<dropped>> ' || left(line, 160) END AS cleaned FROM t2 WHERE line_no < 3")
def clean_dry_run(spark, d):
    return corpus.dry_run(_lines(spark, d), 3)


@query("clean_dedup_lines", r"WITH LINES, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) ORDER BY line_no) AS k FROM lines) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM r WHERE k = 1")
def clean_dedup_lines(spark, d):
    return corpus.dedup_in_document(_lines(spark, d), "line").select("doc_id", "line_no", "line")


@query("clean_keep_rate", f"WITH LINES, q AS (SELECT source, {_QUICK} AS c FROM lines), k AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN {_NW('c')} >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM q GROUP BY source) SELECT coalesce(source, 'all') AS source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(kept) AS BIGINT) AS kept, round(100.0 * sum(kept) / sum(n), 1) AS pct FROM k GROUP BY GROUPING SETS ((source), ())")
def clean_keep_rate(spark, d):
    x = _lines(spark, d).select("source", (text.quick_clean(F.col("line")) != "").cast("long").alias("k"))
    x = x.rollup("source").agg(F.count("*").alias("n"), F.sum("k").alias("kept"))
    return x.select(F.coalesce("source", F.lit("all")).alias("source"), "n", "kept", F.round(100.0 * F.col("kept") / F.col("n"), 1).alias("pct"))


@query("clean_phase2_exact")
def clean_phase2_exact(spark, d):
    return corpus.phase2_exact(table(spark, d, "documents"))


_SENT = """sents AS (SELECT doc_id, source, lang, unnest(range(len(p))) AS pos, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS sentence FROM
  (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents))"""
_CLEAN = f"""cl AS (SELECT * FROM sents WHERE {_NW('sentence')} BETWEEN 8 AND 30 AND regexp_matches(sentence, '^\\p{{Lu}}') AND regexp_matches(sentence, '[.!?]$') AND sentence <> upper(sentence)
  AND regexp_matches(sentence, '^[A-Za-zÀ-ÿ''’\\- .,;:!?]+$') AND length(sentence) - length(replace(sentence, '.', '')) <= 1 AND length(sentence) - length(replace(sentence, '!', '')) <= 1
  AND length(sentence) - length(replace(sentence, '?', '')) <= 1 AND NOT contains(left(sentence, length(sentence) - 1), '.'))"""
_FIRST = "fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) AS k FROM cl) WHERE k = 1)"


def _sents(spark, d):
    return corpus.sentences(table(spark, d, "documents"))


def _firsts(spark, d):
    return corpus.keep_first(_sents(spark, d).filter(corpus.is_clean(F.col("sentence"))), ["sentence"], ["doc_id", "pos"])


@query("split_sentences", f"WITH {_SENT} SELECT lang, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sents GROUP BY lang")
def split_sentences(spark, d):
    return _sents(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query("evalset_clean_sentences", f"WITH {_SENT}, {_CLEAN}, {_FIRST} SELECT doc_id, source, CAST(pos AS INTEGER) AS pos, sentence FROM fs")
def evalset_clean_sentences(spark, d):
    return _firsts(spark, d).select("doc_id", "source", "pos", "sentence")


_MID = f"""w AS (SELECT doc_id, sentence, {_TOKS.replace('line', 'sentence')} AS w FROM fs), m AS (SELECT doc_id, array_to_string(w[1:len(w)//2], ' ') AS prompt, array_to_string(w[len(w)//2+1:], ' ') AS target, len(w) - len(w)//2 AS tw FROM w)"""


@query("evalset_midpoint_pairs", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_MID} SELECT doc_id, prompt, target, CAST(tw AS BIGINT) AS target_words FROM m WHERE tw BETWEEN 4 AND 12 AND length(target) <= 70")
def evalset_midpoint_pairs(spark, d):
    return corpus.midpoint_pairs(_firsts(spark, d)).select("doc_id", "prompt", "target", F.col("target_words").cast("long").alias("target_words"))


_BUCKET = f"b AS (SELECT *, {_NW('sentence')} AS n, CASE WHEN {_NW('sentence')} <= 9 THEN 'short' WHEN {_NW('sentence')} <= 15 THEN 'mid' ELSE 'long' END AS bucket FROM fs)"


def _buckets(spark, d):
    n = F.size(text.words(F.col("sentence")))
    return _firsts(spark, d).withColumn("n", n).withColumn("bucket", F.when(n <= 9, "short").when(n <= 15, "mid").otherwise("long"))


@query("evalset_buckets", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_BUCKET} SELECT bucket, count(*) AS c, CAST(min(n) AS BIGINT) AS min_words, median(n) AS median_words, CAST(max(n) AS BIGINT) AS max_words, CAST(max(length(sentence)) AS BIGINT) AS max_chars FROM b GROUP BY bucket")
def evalset_buckets(spark, d):
    return _buckets(spark, d).groupBy("bucket").agg(F.count("*").alias("c"), F.min("n").cast("long").alias("min_words"), F.median("n").alias("median_words"), F.max("n").cast("long").alias("max_words"), F.max(F.length("sentence")).cast("long").alias("max_chars"))


@query("evalset_stratified", f"""WITH {_SENT}, {_CLEAN}, {_FIRST}, {_BUCKET}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket, source ORDER BY md5('7' || sentence)) AS rk FROM b),
  q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rk, md5('7' || source)) AS kk FROM r) SELECT bucket, source, sentence FROM q WHERE kk <= CASE bucket WHEN 'short' THEN 8 WHEN 'mid' THEN 20 ELSE 12 END""")
def evalset_stratified(spark, d):
    seeded = lambda c: F.md5(F.concat(F.lit("7"), c))
    x = _buckets(spark, d).withColumn("rk", F.row_number().over(Window.partitionBy("bucket", "source").orderBy(seeded(F.col("sentence")))))
    x = x.filter("rk <= 20").withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("rk", seeded(F.col("source")))))
    return x.filter(F.col("k") <= F.when(F.col("bucket") == "short", 8).when(F.col("bucket") == "mid", 20).otherwise(12)).select("bucket", "source", "sentence")


_BENCH = _SENT.replace("sents AS", "bs AS").replace("doc_id, source, lang, ", "item_id, ").replace("FROM documents", "FROM benchmark")


@query("evalset_exclude", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_BENCH} SELECT doc_id, sentence FROM fs WHERE sentence NOT IN (SELECT sentence FROM bs)")
def evalset_exclude(spark, d):
    used = table(spark, d, "benchmark").select(F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).select(text.strip(F.col("sentence")).alias("sentence")).distinct()
    return _firsts(spark, d).join(used, "sentence", "left_anti").select("doc_id", "sentence")


@query("leakage_filter", r"WITH LINES, b AS (SELECT DISTINCT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM benchmark), x AS (SELECT source, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines) SELECT source, count(*) AS n, CAST(sum(CASE WHEN line IN (SELECT line FROM b) THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM x GROUP BY source")
def leakage_filter(spark, d):
    held = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(text.strip(F.col("line")).alias("line"), F.lit(1).alias("hit")).distinct()
    # A blank line, the hottest of all, is looked up apart: it is a null key, which no join gathers.
    blank = held.filter("line = ''").limit(1).count() > 0
    x = _lines(spark, d).select("source", F.nullif(text.strip(F.col("line")), F.lit("")).alias("line")).join(held.filter("line <> ''"), "line", "left")
    x = x.withColumn("hit", F.coalesce("hit", F.when(F.col("line").isNull() & F.lit(blank), 1)))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("skipped"))


@query("html_paragraphs", r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS p FROM pages), c AS (SELECT page_id, trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM p)
  SELECT page_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM c WHERE length(p) > 40 GROUP BY page_id""")
def html_paragraphs(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))).alias("p"))
    p = p.withColumn("p", F.trim(F.regexp_replace(F.regexp_replace("p", "<[^>]*>", " "), r"\s+", " "))).filter(F.length("p") > 40)
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


@query("html_extract_exact")
def html_extract_exact(spark, d):
    return corpus.extract_paragraphs(table(spark, d, "pages")).select("page_id", F.size("paragraphs").alias("n"), F.array_join("paragraphs", "\n\n").alias("text"))


@query("lang_filter", f"""WITH w AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)
  SELECT doc_id, lang, len(list_filter(w, lambda x: x IN {_in(corpus.INDICATORS)})) / len(w) < 0.05 AS passes FROM w WHERE len(w) > 0""")
def lang_filter(spark, d):
    w = table(spark, d, "documents").select("doc_id", "lang", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("w")).filter("size(w) > 0")
    hit = F.size(F.filter("w", lambda x: x.isin(*corpus.INDICATORS)))
    return w.select("doc_id", "lang", (hit / F.size("w") < 0.05).alias("passes"))


@query("boilerplate_prompts", f"""WITH LINES, a AS (SELECT doc_id, line_no, line, {_TOKS} AS w FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) >= 100) AND length(line) >= 40 AND NOT regexp_matches(line, '{corpus.BOILERPLATE}') AND 2 * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= length(line)),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left(line, 50) ORDER BY line_no) AS r FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS q FROM k WHERE r = 1 AND len(w) >= 5),
  p AS (SELECT doc_id, CAST(q AS INTEGER) AS q, array_to_string(w[1:10], ' ') AS prompt FROM n WHERE q <= 3) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY doc_id, q) = 1""")
def boilerplate_prompts(spark, d):
    """Openings of prose lines, three a document at most, each prompt once in the corpus, where it comes first."""
    long = table(spark, d, "documents").filter(F.length("text") >= 100)
    x = lines(long).filter((F.length("line") >= 40) & ~F.col("line").rlike(corpus.BOILERPLATE) & (2 * F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= F.length("line")))
    x = corpus.keep_first(x, ["doc_id", F.left("line", F.lit(50))], ["line_no"]).withColumn("w", text.words(F.col("line"))).filter("size(w) >= 5")
    x = x.withColumn("q", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("q <= 3")
    prompts = x.groupBy(F.array_join(F.slice("w", 1, 10), " ").alias("prompt")).agg(F.min(F.struct("doc_id", "q")).alias("f"))
    return prompts.select("f.doc_id", "f.q", "prompt")


@query("source_exclusion", "WITH LINES SELECT source, count(*) AS n FROM lines WHERE NOT contains(source, 'src1') GROUP BY source")
def source_exclusion(spark, d):
    return exclude_sources(_lines(spark, d), ["src1"]).groupBy("source").agg(F.count("*").alias("n"))


@query("global_line_index", "WITH LINES SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_idx FROM lines")
def global_line_index(spark, d):
    return with_global_index(_lines(spark, d)).select("doc_id", "line_no", F.col("line_idx").cast("long").alias("line_idx"))


@query("exact_doc_dedup", "SELECT doc_id, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_doc_dedup(spark, d):
    # a grouped minimum combines map-side, so a large group of copies costs no single task
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query("template_concentration", f"""WITH LINES, p AS (SELECT array_to_string(w[1:3], ' ') AS prefix, coalesce(w[4], '') AS nxt FROM (SELECT {_TOKS} AS w FROM lines) WHERE len(w) >= 4), c AS (SELECT prefix, nxt, count(*) AS n FROM p GROUP BY 1, 2),
  s AS (SELECT prefix, CAST(sum(n) AS BIGINT) AS total, max(n) AS top FROM c GROUP BY prefix) SELECT prefix, total, top, round(100.0 * top / total, 3) AS share FROM s WHERE total >= 3""")
def template_concentration(spark, d):
    p = _lines(spark, d).select(text.words(F.col("line")).alias("w")).filter("size(w) >= 4").select(F.array_join(F.slice("w", 1, 3), " ").alias("prefix"), F.get("w", F.lit(3)).alias("nxt"))
    s = p.groupBy("prefix", "nxt").agg(F.count("*").alias("n")).groupBy("prefix").agg(F.sum("n").alias("total"), F.max("n").alias("top")).filter("total >= 3")
    return s.select("prefix", "total", "top", F.round(100.0 * F.col("top") / F.col("total"), 3).alias("share"))


# --- tokens: a character tokenizer stands in for the subword model, so that SQL can follow ------------


@query("fertility", f"WITH LINES, w AS (SELECT lang, unnest({_TOKS}) AS w FROM lines) SELECT lang, count(*) AS n_words, CAST(sum(CAST(ceil(length(w) / 3.0) AS BIGINT)) AS BIGINT) AS n_tokens, round(sum(CAST(ceil(length(w) / 3.0) AS BIGINT)) / count(*), 6) AS fertility FROM w GROUP BY lang")
def fertility(spark, d):
    w = _lines(spark, d).select("lang", F.explode(text.words(F.col("line"))).alias("w")).withColumn("t", F.size(tokens.pieces(F.col("w"))).cast("long"))
    return w.groupBy("lang").agg(F.count("*").alias("n_words"), F.sum("t").alias("n_tokens"), F.round(F.sum("t") / F.count("*"), 6).alias("fertility"))


@query("token_histogram", f"WITH LINES, w AS (SELECT DISTINCT unnest({_TOKS}) AS w FROM lines), h AS (SELECT CAST(length(w) AS BIGINT) AS len, count(*) AS n FROM w GROUP BY 1) SELECT len, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM h")
def token_histogram(spark, d):
    h = _lines(spark, d).select(F.explode(text.words(F.col("line"))).alias("w")).distinct().groupBy(F.length("w").cast("long").alias("len")).agg(F.count("*").alias("n"))
    return h.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("vocab_pad", f"WITH LINES, w AS (SELECT unnest({_TOKS}) AS w FROM lines), v AS (SELECT count(DISTINCT w) AS v FROM w) SELECT v, v + 4 AS with_fim, ((v + 4 + 63) // 64) * 64 AS padded FROM v")
def vocab_pad(spark, d):
    v = _lines(spark, d).select(F.explode(text.words(F.col("line"))).alias("w")).agg(F.count_distinct("w").alias("v"))
    return v.select("v", (F.col("v") + 4).alias("with_fim"), F.expr("((v + 4 + 63) div 64) * 64").alias("padded"))


_LEN = f"WITH LINES, l AS (SELECT doc_id, line_no, {_NW('line')} AS n FROM lines)"


@query("flat_chunks", f"{_LEN}, t AS (SELECT doc_id, sum(n + 1) AS n FROM l GROUP BY doc_id) SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST((n - 1) // 128 AS BIGINT) AS windows, CAST(n - 1 - 128 * ((n - 1) // 128) AS BIGINT) AS dropped FROM t")
def flat_chunks(spark, d):
    return tokens.flat_chunks(_lines(spark, d), 128)


@query("packed_windows")
def packed_windows(spark, d):
    return tokens.packed(_lines(spark, d), 128)


_FIM = f"""x AS (SELECT doc_id, line_no, {_TOKS} AS w FROM lines), h AS (SELECT *, len(w) AS n, ('0x' || substr(md5('a' || doc_id || ':' || line_no), 1, 7))::BIGINT AS ha, ('0x' || substr(md5('b' || doc_id || ':' || line_no), 1, 7))::BIGINT AS hb,
  ('0x' || substr(md5('c' || doc_id || ':' || line_no), 1, 7))::BIGINT AS hc FROM x WHERE len(w) >= 10), c AS (SELECT *, ha % (n - 1) AS p1 FROM h WHERE hc % 2 = 0), e AS (SELECT *, p1 + 2 + hb % (n - p1 - 1) AS p2 FROM c)"""


@query("fim_examples", f"WITH LINES, {_FIM} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(w[1:p1], ' ') AS prefix, array_to_string(w[p1+1:p2], ' ') AS middle, array_to_string(w[p2+1:], ' ') AS suffix, CASE WHEN (hc // 2) % 2 = 0 THEN 'psm' ELSE 'spm' END AS mode FROM e")
def fim_examples(spark, d):
    return tokens.fim(_lines(spark, d)).select("doc_id", "line_no", F.array_join("prefix", " ").alias("prefix"), F.array_join("middle", " ").alias("middle"), F.array_join("suffix", " ").alias("suffix"), "mode")


@query("fim_roundtrip", f"WITH LINES, {_FIM} SELECT count(*) AS n, count(*) AS same FROM e")
def fim_roundtrip(spark, d):
    x = tokens.fim(_lines(spark, d))
    return x.agg(F.count("*").alias("n"), F.count_if(F.concat("prefix", "middle", "suffix") == F.col("w")).alias("same"))


@query("embedding_mean", "WITH e AS (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY dim")
def embedding_mean(spark, d):
    return table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("quality_by_label", "WITH LINES SELECT quality, toxic, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_by_label(spark, d):
    return _lines(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))
