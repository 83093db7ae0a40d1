"""Registered queries: evaluation-set cuts, token streams and windows, tokenizer checks, telemetry details, cross-document operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tallgrass.functions import suggestion, text
from tallgrass.operators import corpus, draws, evalset, metrics, setjoin, stream, telemetry, tokens, unigram
from tallgrass.plans.corpus import _CLEAN, _FIM, _FIRST, _LANG, _SENT, _TOKS, _firsts, _lines, _sents
from tallgrass.plans.evaluation import PAIRS, _pairs, _tele
from tallgrass.plans.registry import query
from tallgrass.sources import npy
from tallgrass.sources.corpus import table, with_global_index
from tallgrass.sources.shared import new_path

_CUT = """w AS (SELECT doc_id, sentence, {toks} AS w FROM fs), n AS (SELECT *, len(w) AS n, greatest(2, len(w) - {back}) AS lo, len(w) - {ahead} AS hi FROM w WHERE len(w) >= 8), c AS (SELECT *, lo + ('0x' || substr(md5('7' || sentence), 1, 7))::BIGINT % (hi - lo + 1) AS cut FROM n WHERE hi > lo)
  SELECT doc_id, array_to_string(w[1:cut], ' ') AS prompt, array_to_string(w[cut + 1:], ' ') AS target, CASE WHEN n - cut <= 6 THEN 'short' WHEN n - cut <= 9 THEN 'medium' ELSE 'long' END AS category FROM c"""
_COUNTS = _LANG[: _LANG.index(" f AS")].rstrip().rstrip(",")
_SW = _TOKS.replace("(line,", "(sentence,")


def _cut(spark, d, back, ahead):
    x = evalset.late_cut(_firsts(spark, d), back, ahead)
    return x.select("doc_id", "prompt", "target", evalset.category(F.col("target_words")).alias("category"))


@query("heldout_pairs", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_CUT.format(toks=_SW, back=12, ahead=4)}")
def heldout_pairs(spark, d):
    return _cut(spark, d, 12, 4)


@query("fresh_prompts", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_CUT.format(toks=_SW, back=10, ahead=4)}")
def fresh_prompts(spark, d):
    return _cut(spark, d, 10, 4)


@query("real_prompts", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_CUT.format(toks=_SW, back=9, ahead=3)}")
def real_prompts(spark, d):
    return _cut(spark, d, 9, 3)


@query("heldout_categories", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, x AS (WITH {_CUT.format(toks=_SW, back=12, ahead=4)}) SELECT category, count(*) AS n, CAST(min(length(target)) AS BIGINT) AS min_chars, median(length(target)) AS median_chars, CAST(max(length(target)) AS BIGINT) AS max_chars FROM x GROUP BY category")
def heldout_categories(spark, d):
    n = F.length("target")
    return _cut(spark, d, 12, 4).groupBy("category").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min_chars"), F.median(n).alias("median_chars"), F.max(n).cast("long").alias("max_chars"))


@query("prompt_gold_zip", "WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text AS prompt FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text AS gold FROM conversations WHERE role <> 'user') SELECT conv_id, CAST(pos AS INTEGER) AS pos, prompt, gold FROM u JOIN a USING (conv_id, pos)")
def prompt_gold_zip(spark, d):
    c = table(spark, d, "conversations")
    return evalset.zipped(c.filter("role = 'user'"), c.filter("role <> 'user'"), ["conv_id"], "turn", ("prompt", "gold"))


_BS = _SENT.replace("sents AS", "bs AS").replace("doc_id, source, lang, ", "item_id, ").replace("FROM documents", "FROM benchmark")


@query("exclusion_union", f"WITH {_SENT}, {_CLEAN}, {_FIRST}, {_BS}, used AS (SELECT sentence FROM bs UNION SELECT text FROM conversations UNION SELECT sentence FROM fs WHERE doc_id % 4 = 0) SELECT doc_id, sentence FROM fs WHERE sentence NOT IN (SELECT sentence FROM used WHERE sentence IS NOT NULL)")
def exclusion_union(spark, d):
    """Sentences that no earlier set has: the benchmark, the conversations, an earlier run's."""
    first = _firsts(spark, d)
    bench = table(spark, d, "benchmark").select(F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).select(text.strip(F.col("sentence")).alias("sentence"))
    used = bench.union(table(spark, d, "conversations").select("text")).union(first.filter("doc_id % 4 = 0").select("sentence")).distinct()
    return first.join(used, "sentence", "left_anti").select("doc_id", "sentence")


@query("reference_marks", r"WITH LINES, x AS (SELECT lang, line, regexp_replace(line, '\[[A-Za-z0-9]+\]', '', 'g') AS a, regexp_replace(regexp_replace(line, '\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g') AS b FROM lines) SELECT lang, count(*) FILTER (a <> line) AS marked, CAST(sum(length(a)) AS BIGINT) AS chars, CAST(sum(length(b)) AS BIGINT) AS bare_chars FROM x GROUP BY lang")
def reference_marks(spark, d):
    a, b = evalset.strip_references(F.col("line")), evalset.strip_parentheses(F.col("line"))
    return _lines(spark, d).groupBy("lang").agg(F.count_if(a != F.col("line")).alias("marked"), F.sum(F.length(a)).alias("chars"), F.sum(F.length(b)).alias("bare_chars"))


_VAR = _CLEAN.replace("BETWEEN 8 AND 30", "BETWEEN 6 AND 30")


@query("prompt_sentences", f"WITH {_SENT}, {_VAR} SELECT lang, count(*) AS n, count(*) FILTER (len(list_filter({_SW}, lambda w: length(w) >= 4 AND w = upper(w) AND w <> lower(w))) = 0) AS passes FROM cl GROUP BY lang")
def prompt_sentences(spark, d):
    x = _sents(spark, d).filter(corpus.is_clean(F.col("sentence"), 6))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~evalset.has_shouted_word(F.col("sentence"))).alias("passes"))


@query("first_source", f"WITH {_SENT}, {_CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY source, doc_id, pos) AS k FROM cl), n AS (SELECT sentence, count(DISTINCT source) AS sources FROM cl GROUP BY sentence) SELECT sentence, source, doc_id, sources FROM r JOIN n USING (sentence) WHERE k = 1")
def first_source(spark, d):
    """Cross-source duplicates stay with the first source."""
    x = _sents(spark, d).filter(corpus.is_clean(F.col("sentence")))
    first = F.min(F.struct("source", "doc_id", "pos")).alias("f")
    return x.groupBy("sentence").agg(first, F.count_distinct("source").alias("sources")).select("sentence", "f.source", "f.doc_id", "sources")


@query("valid_lines", "WITH LINES, r AS (SELECT source, doc_id, line_no, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS k FROM lines WHERE length(line) >= 20) SELECT source, doc_id, CAST(line_no AS INTEGER) AS line_no FROM r WHERE k <= 50")
def valid_lines(spark, d):
    """The first fifty lines of twenty characters of each source."""
    x = _lines(spark, d).filter(F.length("line") >= 20).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "line_no")))
    return x.filter("k <= 50").select("source", "doc_id", "line_no")


@query("kept_paragraphs", rf"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda p: NOT (contains(p, 'document.write') OR contains(p, 'function(') OR starts_with(p, 'var ') OR contains(p, '$.ajax')) AND length(p) >= 40) AS p FROM documents) SELECT doc_id, len(p) AS n, array_to_string(p, chr(10) || chr(10)) AS text FROM p WHERE length(array_to_string(p, chr(10) || chr(10))) > 200")
def kept_paragraphs(spark, d):
    p = table(spark, d, "documents").select("doc_id", evalset.kept_paragraphs(F.split("text", "\n")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "\n\n").alias("text")).filter(F.length("text") > 200)


@query("domain_totals", "WITH f AS (SELECT lang || '_' || doc_id AS name, length(text) AS chars FROM documents) SELECT coalesce(split_part(name, '_', 1), 'TOTAL') AS domain, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars FROM f GROUP BY GROUPING SETS ((split_part(name, '_', 1)), ())")
def domain_totals(spark, d):
    f = table(spark, d, "documents").select(F.split_part(F.concat_ws("_", "lang", "doc_id"), F.lit("_"), F.lit(1)).alias("domain"), F.length("text").alias("chars"))
    return f.rollup("domain").agg(F.count("*").alias("files"), F.sum("chars").alias("chars")).withColumn("domain", F.coalesce("domain", F.lit("TOTAL")))


# --- token streams ---------------------------------------------------------------------------------

_ID = "('0x' || substr(md5(x), 1, 6))::BIGINT % 3990 + 5"
_IDS = f"ids AS (SELECT doc_id, line_no, list_append(list_transform({_TOKS}, lambda x: {_ID}), 2) AS ids FROM lines WHERE length(line) > 0)"
_STREAM = f"{_IDS}, st AS (SELECT doc_id, flatten(list(ids ORDER BY line_no)) AS s FROM ids GROUP BY doc_id)"


def _ids(spark, d):
    """A line's token ids and the end id."""
    return tokens.with_end(_lines(spark, d).filter("line <> ''"), tokens.hashed_ids(text.words(F.col("line"))))


@query("token_counters", f"WITH LINES, b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark), k AS (SELECT *, ({_TOKS}) AS w, regexp_matches(line, '\\d{{7,}}') OR line IN (SELECT line FROM b WHERE line IS NOT NULL) AS skipped FROM lines WHERE length(line) > 0) SELECT CAST(sum(CASE WHEN skipped THEN 0 ELSE len(w) + 1 END) AS BIGINT) AS tokens, count(*) FILTER (NOT skipped AND len(w) >= 10) AS n_fim, count(*) FILTER (NOT skipped AND len(w) < 10) AS n_ar, count(*) FILTER (skipped) AS n_skipped FROM k")
def token_counters(spark, d):
    held = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"), F.lit(True).alias("held")).distinct()
    x = _ids(spark, d).join(held, "line", "left").withColumn("skipped", F.coalesce("held", text.has_digit_run(F.col("line"))))
    n = F.size("ids")
    return x.agg(F.sum(F.when(F.col("skipped"), 0).otherwise(n)).alias("tokens"), F.count_if(~F.col("skipped") & (n > 10)).alias("n_fim"), F.count_if(~F.col("skipped") & (n <= 10)).alias("n_ar"), F.count_if("skipped").alias("n_skipped"))


@query("limited_tokens", f"WITH LINES, {_IDS}, g AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_idx FROM ids) SELECT count(*) AS n, CAST(sum(len(ids)) AS BIGINT) AS tokens, max(list_max(ids)) AS max_id FROM g WHERE line_idx < 1000")
def limited_tokens(spark, d):
    """Counts over the first thousand lines of the ordered scan."""
    g = with_global_index(_ids(spark, d)).filter("line_idx < 1000")
    return g.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("tokens"), F.max(F.array_max("ids")).alias("max_id"))


@query("special_tokens", f"WITH LINES, {_FIM}, o AS (SELECT doc_id, line_no, list_concat(CASE WHEN (hc // 2) % 2 = 0 THEN [4000] ELSE [4001] END, [4002, 4003, 2], CASE WHEN (hc // 2) % 2 = 0 THEN [4001] ELSE [4000] END, list_transform(w, lambda x: {_ID})) AS ids FROM e), u AS (SELECT unnest(ids) AS id FROM o) SELECT id, count(*) AS n, (SELECT max(id) FROM u) <= 65535 AS fits FROM u WHERE id < 5 OR id >= 4000 GROUP BY id")
def special_tokens(spark, d):
    """How often each special id stands in the assembled examples, and whether all ids fit two bytes."""
    x = tokens.fim(_lines(spark, d))
    ids = tokens.assembled(*[tokens.hashed_ids(F.col(c)) for c in ("prefix", "middle", "suffix")], F.col("mode"))
    return tokens.special_histogram(x.select(ids.alias("ids")))


@query("example_boundaries", f"WITH LINES, {_STREAM}, e AS (SELECT doc_id, s, list_filter(range(1, len(s) + 1), lambda i: s[i] = 2) AS e FROM st) SELECT doc_id, len(e) AS examples, list_max(list_transform(range(1, len(e) + 1), lambda k: e[k] - CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END)) AS longest, len(s) - coalesce(e[len(e)], 0) AS trailing FROM e")
def example_boundaries(spark, d):
    """Examples end at the end id; what follows the last one is left out."""
    return tokens.boundaries(tokens.streams(_ids(spark, d)))


@query("padded_windows", f"WITH LINES, {_STREAM}, u AS (SELECT doc_id, s, unnest(range(0, (len(s) + 127) // 128)) AS k FROM st), p AS (SELECT doc_id, k, s[k * 128 + 1 : k * 128 + 129] AS w FROM u) SELECT doc_id, k AS window_no, CAST(list_sum(w[1:128]) AS BIGINT) AS x_sum, CAST(coalesce(list_sum(w[2:129]), 0) AS BIGINT) AS y_sum, 129 - len(w) AS padding FROM p")
def padded_windows(spark, d):
    """Windows of 129 ids every 128, the last filled with zeros; inputs and targets are shifted by one."""
    w = tokens.padded_windows(tokens.streams(_ids(spark, d)), 128)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return w.select("doc_id", "window_no", total("x").alias("x_sum"), total("y").alias("y_sum"), F.col("padding").cast("long").alias("padding"))


# --- the whole corpus as one stream ----------------------------------------------------------------

_PLACED = f"""{_IDS}, ex AS (SELECT ids, len(ids) AS n, row_number() OVER o - 1 AS number, CAST(sum(len(ids)) OVER o AS BIGINT) - len(ids) AS s FROM ids WINDOW o AS (ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING)),
 tot AS (SELECT max(s + n) AS total, count(*) AS cnt FROM ex), tk AS (SELECT s + unnest(range(n)) AS t, unnest(ids) AS id FROM ex)"""
_WINDOWS = f"""WITH LINES, {_PLACED}, x AS (SELECT t // 512 AS window_no, md5(string_agg(id, ',' ORDER BY t)) AS x_md5 FROM tk GROUP BY 1), y AS (SELECT (t - 1) // 512 AS window_no, md5(string_agg(id, ',' ORDER BY t)) AS y_md5 FROM tk WHERE t > 0 GROUP BY 1)
 SELECT window_no, x_md5, y_md5 FROM x JOIN y USING (window_no), tot WHERE window_no < (total - 1) // 512"""


def _digest(ids: str | Column) -> Column:
    return F.md5(F.array_join(ids, ",").cast("binary"))


@query("stream_windows", _WINDOWS)
def stream_windows(spark, d):
    """Inputs and targets of all windows of the corpus as one stream; windows cross lines and documents."""
    w = stream.windows(stream.token_stream(_ids(spark, d), ["doc_id", "line_no"]), 512)
    return w.select("window_no", _digest("x").alias("x_md5"), _digest("y").alias("y_md5"))


@query("array_windows", _WINDOWS)
def array_windows(spark, d):
    """The same windows by way of one array file: written in slices, read back by byte ranges."""
    s = stream.token_stream(_ids(spark, d), ["doc_id", "line_no"])
    path = new_path(spark, "tokens") + ".npy"
    npy.write_array(s, path, stream.tokens_of(s))
    w = npy.read_array(spark, path, window=512)
    return w.select((F.col("start") / 512).cast("long").alias("window_no"), _digest(F.slice("ids", 1, 512)).alias("x_md5"), _digest(F.slice("ids", 2, 512)).alias("y_md5"))


@query("stream_packed", f"""WITH RECURSIVE LINES, {_PLACED}, nx AS (SELECT a.number, a.s, a.n, greatest(a.number + 1, coalesce(b.number, (SELECT cnt FROM tot))) AS nxt FROM ex a ASOF LEFT JOIN ex b ON b.s + b.n > a.s + 257),
 w(number) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT nxt FROM w JOIN nx USING (number) WHERE nxt < (SELECT cnt FROM tot)),
 p AS (SELECT nx.s AS window_start, nxt - nx.number AS examples, least(257, coalesce(e.s, (SELECT total FROM tot)) - nx.s) AS length, nx.n > 257 AS truncated FROM w JOIN nx USING (number) LEFT JOIN ex e ON e.number = nxt),
 m AS (SELECT window_start, md5(string_agg(id, ',' ORDER BY t)) AS ids_md5 FROM tk ASOF JOIN p ON t >= window_start WHERE t < window_start + length GROUP BY 1)
 SELECT window_start, examples, length, truncated, 257 - length AS padding, ids_md5 FROM p JOIN m USING (window_start)""")
def stream_packed(spark, d):
    """Greedy packing of whole examples, in the order of the corpus, into windows of 256 ids and a target."""
    w = stream.packed_windows(stream.token_stream(_ids(spark, d), ["doc_id", "line_no"]), 257)
    kept = F.slice(F.concat("x", F.slice("y", -1, 1)), F.lit(1), F.col("length").cast("int"))
    return w.select("window_start", "examples", "length", "truncated", (257 - F.col("length")).alias("padding"), _digest(kept).alias("ids_md5"))


@query("ppl_windows", f"WITH LINES, {_STREAM} SELECT doc_id, len(s) AS tokens, (len(s) - 1) // 64 AS whole, (len(s) - 1) % 64 AS rest, CAST((len(s) - 1) // 64 + CASE WHEN (len(s) - 1) % 64 > 0 THEN 1 ELSE 0 END AS BIGINT) AS windows FROM st")
def ppl_windows(spark, d):
    """Scored windows of a file, the remainder being one of its own."""
    return tokens.ppl_windows(tokens.streams(_ids(spark, d)), 64)


@query("strided_windows", f"WITH LINES, {_STREAM}, n AS (SELECT doc_id, s, (len(s) - 1) // 32 AS n FROM st), u AS (SELECT doc_id, s, n, unnest(range(10)) AS i FROM n WHERE n > 0) SELECT doc_id, i, (i * 7) % n * 32 AS start, s[(i * 7) % n * 32 + 1] AS first_id FROM u")
def strided_windows(spark, d):
    """Ten windows spread over a file by a stride of seven."""
    return tokens.strided(tokens.streams(_ids(spark, d)), 32, 10)


@query("debug_examples", f"WITH LINES, {_FIM}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS k FROM e) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN (hc // 2) % 2 = 0 THEN '<PRE>' || array_to_string(w[1:p1], ' ') || '<SUF>' || array_to_string(w[p2+1:], ' ') || '<MID>' ELSE '<SUF>' || array_to_string(w[p2+1:], ' ') || '<PRE>' || array_to_string(w[1:p1], ' ') || '<MID>' END || array_to_string(w[p1+1:p2], ' ') || '<EOT>' AS shown FROM r WHERE k <= 20")
def debug_examples(spark, d):
    """The first twenty examples as text."""
    join = lambda c: F.array_join(c, " ")
    shown = F.when(F.col("mode") == "psm", F.concat(F.lit("<PRE>"), join("prefix"), F.lit("<SUF>"), join("suffix"))).otherwise(F.concat(F.lit("<SUF>"), join("suffix"), F.lit("<PRE>"), join("prefix")))
    return tokens.fim(_lines(spark, d)).orderBy("doc_id", "line_no").limit(20).select("doc_id", "line_no", F.concat(shown, F.lit("<MID>"), join("middle"), F.lit("<EOT>")).alias("shown"))


@query("word_boundaries", f"WITH LINES, w AS (SELECT doc_id, line_no, {_TOKS} AS w FROM lines), p AS (SELECT doc_id, line_no, flatten(list_transform(w, lambda x: list_transform(range(0, CAST(ceil(length(x) / 3.0) AS BIGINT)), lambda i: i))) AS p FROM w WHERE len(w) > 0) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(len(p) AS BIGINT) AS pieces, array_to_string(list_append(list_filter(range(0, len(p)), lambda i: p[i + 1] = 0), len(p)), ',') AS boundaries FROM p")
def word_boundaries(spark, d):
    """Places at which a word begins, and the end, in the pieces of a line."""
    x = _lines(spark, d).select("doc_id", "line_no", tokens.marked_pieces(text.words(F.col("line"))).alias("p")).filter("size(p) > 0")
    return x.select("doc_id", "line_no", F.size("p").cast("long").alias("pieces"), F.array_join(F.transform(tokens.boundaries_of(F.col("p")), lambda i: i.cast("string")), ",").alias("boundaries"))


@query("fim_pieces")
def fim_pieces(spark, d):
    """Splits of pieces of which a fifth fall on word boundaries."""
    p = _lines(spark, d).select("doc_id", "line_no", tokens.marked_pieces(text.words(F.col("line"))).alias("pieces")).filter("size(pieces) >= 10")
    return tokens.piece_splits(p).select("doc_id", "line_no", "p1", "p2", "on_boundary", F.size("pieces").alias("n"))


# --- tokenizer checks ------------------------------------------------------------------------------

_VOC = f"voc AS (SELECT w FROM (SELECT unnest({_TOKS}) AS w FROM lines) GROUP BY w HAVING count(*) >= 3)"
_ENDINGS = ("tion", "ment", "keit", "heit", "lich", "ung", "ion", "ier")


def _unigram(size: int, of: str = "", most: str = "line_no >= 0") -> str:
    """CTEs: ``sp(w, c, p)``, for each distinct word of the lines the pieces of its best split with a counted
    vocabulary of that size, and where they begin. Best splits grow place by place in a recursive query."""
    return f"""wc{of} AS (SELECT w, count(*) AS n FROM (SELECT unnest({_TOKS}) AS w FROM lines) GROUP BY w), ms{of} AS (SELECT w, n, '▁' || w AS m, unnest(range(length(w) + 1)) AS i FROM wc{of}),
 ss{of} AS (SELECT w, n, i, unnest(range(1, least(6, length(m) - i) + 1)) AS k, m FROM ms{of}), sb{of} AS (SELECT w, n, i, i + k AS j, substr(m, CAST(i + 1 AS BIGINT), CAST(k AS BIGINT)) AS piece FROM ss{of}),
 vc{of} AS (SELECT piece, sum(n) AS n FROM sb{of} WHERE length(piece) = 1 OR NOT regexp_matches(piece, '\\d') GROUP BY piece ORDER BY 2 DESC, 1 LIMIT {size}), vs{of} AS (SELECT piece, round(ln(n / sum(n) OVER ()), 6) AS score FROM vc{of}),
 ed{of} AS (SELECT w, j, list({{'i': i, 'score': coalesce(score, (SELECT min(score) - 10 FROM vs{of})), 'c': CASE WHEN score IS NULL THEN octet_length(encode(piece)) ELSE 1 END}} ORDER BY i) AS es FROM sb{of} LEFT JOIN vs{of} USING (piece) WHERE score IS NOT NULL OR length(piece) = 1 GROUP BY w, j),
 wl{of} AS (SELECT w, list(es ORDER BY j) AS es FROM ed{of} GROUP BY w),
 vt{of}(w, es, j, s, c, p) AS (SELECT w, es, CAST(0 AS BIGINT), [CAST(0 AS DOUBLE)], [CAST(0 AS BIGINT)], [''] FROM wl{of}
  UNION ALL SELECT w, es, j, list_append(s, b.v), list_append(c, c[b.ni * -1 + 1] + b.c), list_append(p, p[b.ni * -1 + 1] || ',' || (b.ni * -1)) FROM (
   SELECT w, es, j + 1 AS j, s, c, p, list_max(list_transform(es[j + 1], lambda x: {{'v': s[x.i + 1] + x.score, 'ni': -x.i, 'c': x.c}})) AS b FROM vt{of} WHERE j < len(es))),
 sp{of} AS (SELECT w, c[-1] AS c, p[-1] || ',' AS p FROM vt{of} WHERE j = len(es))"""


def _vocabulary(lines, size: int):
    return unigram.counted(unigram.word_counts(lines), size)


@query("fim_exact")
def fim_exact(spark, d):
    """Splits of a line's unigram pieces as a generator seeded with the line's index draws them."""
    lines = with_global_index(_lines(spark, d).filter("line <> ''"))
    x = unigram.encoded(lines, _vocabulary(lines, 2000), pieces=True).select("line_idx", "pieces").filter("size(pieces) >= 10")
    x = x.select("line_idx", F.size("pieces").alias("n"), draws.split_points(F.col("pieces"), F.col("line_idx")).alias("s"))
    return x.select("line_idx", "n", "s.p1", "s.p2")


@query("shuffled_prompts")
def shuffled_prompts(spark, d):
    """The first 500 of the benchmark's and conversations' lines of eight words or more, after a seeded shuffle."""
    b = table(spark, d, "conversations").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.size(text.words(F.col("line"))) >= 8).distinct()
    return draws.first_shuffled(b, ["line"], 7, 500)


@query("viterbi_pieces", f"WITH RECURSIVE LINES, {_unigram(2000)}, u AS (SELECT doc_id, unnest({_TOKS}) AS w FROM lines) SELECT doc_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS n, CAST(coalesce(sum(len(string_split(p, ',')) - 2), 0) AS BIGINT) AS spans FROM documents LEFT JOIN u USING (doc_id) LEFT JOIN sp USING (w) GROUP BY doc_id")
def viterbi_pieces(spark, d):
    """Unigram segmentation of every text, with a vocabulary of 2000 pieces counted from all words: pieces,
    and pieces when the bytes of a character that no piece has count once."""
    v = _vocabulary(_lines(spark, d), 2000)
    x = unigram.encoded(table(spark, d, "documents").select("doc_id", "text"), v, "text")
    first = [v.bytes[b] for b in range(256) if b & 0xC0 != 0x80]  # a character's first byte
    spans = F.size(F.filter("ids", lambda i: (i >= len(unigram.SPECIAL) + 256) | i.isin(first)))
    return x.select("doc_id", F.size("ids").cast("long").alias("n"), spans.cast("long").alias("spans"))


@query("tokenizer_checks", f"WITH RECURSIVE LINES, {_unigram(1000)}, r AS (SELECT sum(wc.n * c) / sum(wc.n) AS fertility FROM wc JOIN sp USING (w)), s AS (SELECT 259 + (SELECT count(*) FROM vs) AS size, round(CAST(fertility AS DOUBLE), 6) AS fertility FROM r) SELECT CAST(size AS INTEGER) AS size, 0 AS unk_id, 1 AS bos_id, 2 AS eos_id, true AS eos_ok, 0.0::DOUBLE AS unk_rate, fertility, true AS unk_ok, fertility > 2.0 AND fertility < 3.0 AS fertility_ok, fertility > 2.0 AND fertility < 3.0 AS verdict FROM s")
def tokenizer_checks(spark, d):
    """Vocabulary size, special ids, share of unknown pieces, fertility, and the verdict on them."""
    words = unigram.word_counts(_lines(spark, d))
    return unigram.checks(words, unigram.counted(words, 1000))


@query("fertility_sample", f"WITH RECURSIVE LINES, {_unigram(1000)}, f AS (SELECT line FROM lines WHERE line <> '' ORDER BY doc_id, line_no LIMIT 1000), u AS (SELECT unnest({_TOKS}) AS w FROM f) SELECT count(*) AS words, CAST(sum(c) AS BIGINT) AS tokens, round(sum(c) / count(*), 6) AS fertility FROM u JOIN sp USING (w)")
def fertility_sample(spark, d):
    """Pieces a word over the first thousand lines, each word encoded by itself; the feature is the sample."""
    all_lines = _lines(spark, d)
    sample = unigram.word_counts(with_global_index(all_lines.filter("line <> ''")).filter("line_idx < 1000"))
    x = unigram.encoded(sample, _vocabulary(all_lines, 1000), "w").select("n", (F.size("ids") * F.col("n")).alias("t"))
    return x.agg(F.sum("n").alias("words"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("n"), 6).alias("fertility"))


@query("verb_splits", f"WITH RECURSIVE LINES, {_unigram(1000)}, u AS (SELECT DISTINCT lang, unnest({_TOKS}) AS w FROM lines) SELECT lang, count(*) AS words, count(*) FILTER (c >= 2) AS split, min(c) >= 2 AS all_split FROM u JOIN sp USING (w) WHERE length(w) >= 8 GROUP BY lang")
def verb_splits(spark, d):
    """Distinct words of eight letters or more, and those in two pieces or more."""
    lines = _lines(spark, d)
    w = lines.select("lang", F.explode(text.words(F.col("line"))).alias("w")).filter("length(w) >= 8").distinct()
    n = F.size("ids")
    return unigram.encoded(w, _vocabulary(lines, 1000), "w").groupBy("lang").agg(F.count("*").alias("words"), F.count_if(n >= 2).alias("split"), (F.min(n) >= 2).alias("all_split"))


_ENDED = "SELECT DISTINCT '{name}' AS tokenizer, lang, w, contains(p, ',' || (length(w) + 1 - length(e)) || ',') AS ok FROM (SELECT lang, unnest({toks}) AS w FROM lines) JOIN en ON ends_with(w, e) AND length(w) >= length(e) + 2 JOIN sp{of} USING (w)"


@query("boundary_consistency", f"""WITH RECURSIVE LINES, {_unigram(500, "a")}, {_unigram(4000, "b")}, en AS (SELECT unnest({list(_ENDINGS)}) AS e), r AS ({_ENDED.format(name="small", toks=_TOKS, of="a")} UNION ALL {_ENDED.format(name="large", toks=_TOKS, of="b")})
 SELECT tokenizer, lang, count(*) AS words, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS consistency FROM (SELECT tokenizer, lang, w, bool_or(ok) AS ok FROM r GROUP BY ALL) GROUP BY 1, 2""")
def boundary_consistency(spark, d):
    """Share of words whose ending begins a piece, by tokenizer (a small and a large vocabulary): words by
    tokenizer as JSON maps of a word to its result, as reports store them, and their means."""
    lines = _lines(spark, d)
    w = lines.select("lang", F.explode(text.words(F.col("line"))).alias("w")).distinct()
    w = w.withColumn("e", F.explode(F.filter(F.array(*map(F.lit, _ENDINGS)), lambda e: F.endswith("w", e) & (F.length("w") >= F.length(e) + 2))))
    words, reports = unigram.word_counts(lines), []
    for name, size in (("small", 500), ("large", 4000)):
        x = unigram.encoded(w, unigram.counted(words, size), "w", pieces=True).withColumn("pieces", F.transform("pieces", lambda p: F.when(p.rlike("^<0x[0-7C-F]"), F.lit(" ")).when(p.startswith("<0x"), F.lit("")).otherwise(p)))
        x = x.withColumn("ok", unigram.begins_at(F.col("pieces"), F.length("w") + 1 - F.length("e"))).groupBy("lang", "w").agg(F.bool_or("ok").alias("ok"))
        # A map a word, so that no language's words are gathered in one row.
        reports.append(x.select(F.lit(name).alias("tokenizer"), "lang", F.to_json(F.create_map("w", F.struct(F.col("ok").alias("boundary_correct")))).alias("per_word")))
    per = reports[0].unionByName(reports[1]).select("tokenizer", "lang", F.explode(F.map_values(F.from_json("per_word", "map<string, struct<boundary_correct: boolean>>"))).alias("x"))
    return per.groupBy("tokenizer", "lang").agg(F.count("*").alias("words"), F.round(100.0 * F.count_if("x.boundary_correct") / F.count("*"), 4).alias("consistency"))


@query("visual_tokens", "WITH p AS (SELECT item_id, unnest(list_transform(string_split(text, ' '), lambda w: '▁' || w)) AS piece, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark) SELECT item_id, CAST(pos AS INTEGER) AS pos, CASE WHEN piece = '▁' THEN ' ' ELSE substr(piece, 2) END AS token, true AS space_before FROM p")
def visual_tokens(spark, d):
    p = table(spark, d, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda w: F.concat(F.lit("▁"), w)).alias("p"))
    return p.select("item_id", F.posexplode(suggestion.visual_tokens(F.col("p"))).alias("pos", "t")).select("item_id", "pos", "t.token", "t.space_before")


@query("appended_pieces", f"WITH LINES, {_VOC}, v AS (SELECT row_number() OVER (ORDER BY w) - 1 AS id, w AS piece FROM voc), n AS (SELECT count(*) AS n FROM v) SELECT (SELECT n FROM n) AS old_size, (SELECT n FROM n) + 4 AS new_size, 0 AS moved")
def appended_pieces(spark, d):
    """New pieces come after the old ones, whose ids don't change."""
    w = _lines(spark, d).select(F.explode(text.words(F.col("line"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter("n >= 3").select("piece")
    old = tokens.numbered(w, "piece")
    return tokens.append_check(old, tokens.appended(old, ["<PRE>", "<SUF>", "<MID>", "<EOT>"]))


# --- telemetry details -----------------------------------------------------------------------------


@query("tele_private", "WITH TELE SELECT id, CASE WHEN session_id % 2 = 0 THEN left(repeat(event_type || ' ', 60), 500) END AS suggestion_text, regexp_replace(regexp_replace('models/v' || model || '.Q5.gguf', '^.*/', ''), '\\.gguf$', '') AS short_model, date_trunc('second', timestamp) AS at FROM tele")
def tele_private(spark, d):
    x = _tele(spark, d)
    long = F.repeat(F.concat("event_type", F.lit(" ")), F.lit(60))
    name = F.concat(F.lit("models/v"), "model", F.lit(".Q5.gguf"))
    raw = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return x.select("id", telemetry.redacted(long, F.col("session_id") % 2 == 0).alias("suggestion_text"), telemetry.short_model(name).alias("short_model"), telemetry.normal_time(raw).cast("timestamp_ntz").alias("at"))


@query("tele_context", "WITH TELE, c AS (SELECT *, CASE WHEN id % 4 = 0 THEN '' ELSE 'ctx' || id END AS context FROM tele), g AS (SELECT suggestion_id, arg_max(context, id) FILTER (event_type = 'suggested') AS shown, arg_max(context, id) FILTER (event_type = 'accepted') AS taken FROM c GROUP BY suggestion_id) SELECT suggestion_id, coalesce(nullif(shown, ''), taken) AS context FROM g WHERE shown IS NOT NULL")
def tele_context(spark, d):
    c = _tele(spark, d).withColumn("context", F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("ctx"), F.col("id").cast("string"))))
    return telemetry.contexts(c)


@query("tele_grid", "WITH TELE, b AS (SELECT DISTINCT date_trunc('day', timestamp) AS bucket FROM tele), m AS (SELECT DISTINCT model FROM tele), c AS (SELECT date_trunc('day', timestamp) AS bucket, model, count(*) AS n FROM tele GROUP BY 1, 2) SELECT bucket, model, coalesce(n, 0) AS n FROM b CROSS JOIN m LEFT JOIN c USING (bucket, model)")
def tele_grid(spark, d):
    """A zero-filled grid of days and models; the models, a short list, are a map in each day's row."""
    return telemetry.grid(_tele(spark, d).withColumn("bucket", F.date_trunc("day", "timestamp"))).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("tele_recent_of_model", "WITH TELE SELECT id, model, event_type FROM tele WHERE model = 'm1' ORDER BY id DESC LIMIT 50")
def tele_recent_of_model(spark, d):
    return telemetry.recent(_tele(spark, d), 50, "m1").select("id", "model", "event_type")


@query("flush_batches")
def flush_batches(spark, d):
    """Client buffering: a batch is sent at twenty events or five seconds after its first."""
    return telemetry.flushed(_tele(spark, d)).groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


# --- described operators ---------------------------------------------------------------------------


@query("global_line_dedup", r"WITH LINES, n AS (SELECT *, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS k FROM lines WHERE length(line) >= 20), m AS (SELECT k, min(doc_id * 1000000 + line_no) AS first, count(*) AS c FROM n GROUP BY k) SELECT n.doc_id, CAST(n.line_no AS INTEGER) AS line_no, c AS copies FROM n JOIN m ON n.k = m.k AND n.doc_id * 1000000 + n.line_no = m.first")
def global_line_dedup(spark, d):
    """Lines repeated across documents stay where they stand first: a grouped minimum, keyed by digest."""
    key = F.sha2(F.lower(text.strip(F.col("line"))), 256)
    x = _lines(spark, d).filter(F.length("line") >= 20).groupBy(key.alias("k")).agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.count("*").alias("copies"))
    return x.select("f.doc_id", "f.line_no", "copies")


_PRIORITY = ("src7", "src3", "src12", "src0")


@query("source_priority", f"WITH p AS (SELECT *, sha256(text) AS k, coalesce(nullif(list_position({list(_PRIORITY)}, source), 0), 5) AS place FROM documents WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place, source NULLS FIRST, doc_id) AS i, count(*) OVER (PARTITION BY k) AS n FROM p) SELECT source, doc_id, n FROM r WHERE i = 1")
def source_priority(spark, d):
    """Of equal texts the one from the source that a given order prefers."""
    return evalset.by_source_priority(table(spark, d, "documents").filter("text IS NOT NULL"), F.sha2("text", 256), "source", ["doc_id"], _PRIORITY)


@query("safe_yield", f"WITH LINES, f AS (SELECT source, {' OR '.join(f'regexp_matches(line, {chr(39)}{p}{chr(39)})' for p in corpus.ARTEFACTS.values())} AS artefact, length(line) > 512 AS long, regexp_matches(line, '\\d{{7,}}') AS digits FROM lines) SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (NOT artefact AND NOT long AND NOT digits) / count(*), 3) AS safe_pct, count(*) FILTER (artefact) AS artefacts, count(*) FILTER (NOT artefact AND long) AS overlong, count(*) FILTER (NOT artefact AND NOT long AND digits) AS digit_runs FROM f GROUP BY source")
def safe_yield(spark, d):
    """Artefact taxonomy, the first label that holds, and the share of lines that are safe to learn from."""
    x = corpus.with_artefacts(_lines(spark, d))
    artefact = None
    for name in corpus.ARTEFACTS:
        artefact = F.col(name) if artefact is None else artefact | F.col(name)
    label = F.when(artefact, "artefact").when(F.length("line") > 512, "overlong").when(text.has_digit_run(F.col("line")), "digits").otherwise("safe")
    n = lambda k: F.count_if(F.col("label") == k)
    return x.select("source", label.alias("label")).groupBy("source").agg(F.count("*").alias("n"), F.round(100.0 * n("safe") / F.count("*"), 3).alias("safe_pct"), n("artefact").alias("artefacts"), n("overlong").alias("overlong"), n("digits").alias("digit_runs"))


@query("language_mix", f"WITH LINES, {_COUNTS}, m AS (SELECT lang, CASE WHEN len(w) < 3 THEN 'too_short' WHEN b = 0 AND a > 0 THEN 'target' WHEN a = 0 AND b > 0 THEN 'other' WHEN a >= 2 * b AND a > 0 THEN 'mostly_target' WHEN a > 0 OR b > 0 THEN 'mixed' ELSE 'unknown' END AS mix FROM c) SELECT lang, mix, count(*) AS n FROM m GROUP BY 1, 2")
def language_mix(spark, d):
    x = corpus.with_language(_lines(spark, d))
    a, b = F.col("n_first"), F.col("n_second")
    mix = F.when(F.col("n_words") < 3, "too_short").when((b == 0) & (a > 0), "target").when((a == 0) & (b > 0), "other").when((a >= 2 * b) & (a > 0), "mostly_target").when((a > 0) | (b > 0), "mixed").otherwise("unknown")
    return x.groupBy("lang", mix.alias("mix")).agg(F.count("*").alias("n"))


@query("message_savings", f"WITH {PAIRS}, x AS (SELECT p.conv_id, p.word, g.word IS NOT NULL AS hit FROM pairs p LEFT JOIN pred g ON g.prev = p.prev AND g.word = p.word AND g.rank <= 3) SELECT conv_id % 10 AS bucket, count(*) AS words, round(coalesce(sum(length(word)) FILTER (hit), 0) / sum(length(word)), 6) AS saved FROM x GROUP BY 1")
def message_savings(spark, d):
    """Share of a message's letters that a shown next word saves before any is typed."""
    p = _pairs(spark, d)
    x = p.join(metrics.bigram_predictions(p, 3).select("prev", "word", "rank"), ["prev", "word"], "left")
    return x.groupBy((F.col("conv_id") % 10).alias("bucket")).agg(F.count("*").alias("words"), F.round(F.sum(F.when(F.col("rank").isNotNull(), F.length("word")).otherwise(0)) / F.sum(F.length("word")), 6).alias("saved"))


_GRAM = "SELECT {id}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t}) WHERE len(w) >= 8"


@query("contamination_grams", f"WITH b AS (SELECT DISTINCT g, item_id FROM ({_GRAM.format(id='item_id', t='benchmark')})), x AS (SELECT DISTINCT doc_id, g FROM ({_GRAM.format(id='doc_id', t='documents')})) SELECT doc_id, item_id, count(*) AS shared FROM x JOIN b USING (g) GROUP BY 1, 2")
def contamination_grams(spark, d):
    """Eight-word runs that documents share with benchmark items."""

    def grams(t, key):
        w = table(spark, d, t).select(key, text.words(F.lower("text")).alias("w")).filter("size(w) >= 8")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))
        return w.select(key, F.explode(F.array_distinct(runs)).alias("g"))

    both = grams("documents", "doc_id").join(grams("benchmark", "item_id"), "g")
    return both.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


_SHINGLES = "SELECT DISTINCT {id}, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t}) WHERE len(w) > 0)"


@query("contamination_near", f"WITH b AS ({_SHINGLES.format(id='item_id', t='benchmark')}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), x AS ({_SHINGLES.format(id='doc_id', t='documents')}) SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS n FROM x JOIN b USING (g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * any_value(n)")
def contamination_near(spark, d):
    """Documents that hold a benchmark item or a near copy of it: four fifths of its five-word shingles."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = setjoin.contained(b, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("query").alias("item_id"), "shared", "n")
