"""Audit, cleaning, extraction and evaluation-set operators over line tables."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text

# Weak language signals of the audit.
EU = "eta da ez izan izanen gara dut dugu gure zure zuen bat ere bai gaur hemen hor hau hori dago dira zen dute du edo baina asko mila esker ikusi euskaraz bezala arte gisa".split()
ES = "de la el que y en los las del por con para una un se al lo como pero mas más sin sus le ya o este esta hoy hola gracias buenos dias días".split()
# Indicator words of the paragraph language filter.
INDICATORS = (
    "que por del los las una para con mas ser ha su como pero cuando donde sin sobre hasta desde entre durante antes despues porque tambien ya "
    "ocho nueve diez veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil millones "
    "directora director general salud servicio vasco resolutions mediante resolucion "
    "julio noviembre diciembre enero febrero marzo abril mayo junio agosto septiembre octubre"
).split()
# Boilerplate lines of prompt mining.
BOILERPLATE = "(?i)" + "|".join([
    r"Edukira salto", r"Salto egin nabigazio", r"Fitxategiak deskargatzeko", r"Sartu Erabilera", r"\.c-mainarticle", r"@\s*media", r"display:\s*(block|none)", r"<!--", r"document\.all", r"loadMenus",
    r"^\s*\}+\s*$", r"^\s*\{+.*\}+\s*$", r"^\d+\.\s*bideoa", r"^\d+\.\s*gaia", r"^\d+\s*Unitate", r"^\d+\s*Blokea", r"^•\s", r"EFE\s*$", r"^\s*/\s*Bideoen", r"^\s*/\s*Oharrak",
])
# Artefact patterns of the audit.
ARTEFACTS = {
    "url": r"(?i)https?://\S+|www\.\S+",
    "email": r"\b\S+@\S+\.\S+\b",
    "mention": r"(?:^|[^\p{L}\p{N}_])@[\p{L}\p{N}_]+",
    "hashtag": r"(?:^|[^\p{L}\p{N}_])#[\p{L}\p{N}_]+",
    "html": r"&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);|<[^>]+>",
    "replacement_char": "�",
    "emoji": r"[\x{2500}-\x{27BF}\x{1F000}-\x{1FFFF}]",
    "punct_run": "!{3,}|[?]{3,}|¿{3,}|¡{3,}|[.]{3,}|,{3,}|;{3,}|:{3,}|[!?¿¡.,;:](?:\\s*[!?¿¡.,;:]){2,}",
}
WORD = r"[\p{L}\p{N}_'-]+"


def with_language(lines: DataFrame, first: list[str] = EU, second: list[str] = ES) -> DataFrame:
    """Occurrences of two stop lists and the label that they suggest."""
    found = lines.withColumn("_w", F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    found = found.withColumn("n_first", F.size(F.filter("_w", lambda w: w.isin(*first)))).withColumn("n_second", F.size(F.filter("_w", lambda w: w.isin(*second)))).withColumn("n_words", F.size("_w")).drop("_w")
    label = (
        F.when((F.col("n_first") >= 2) & (F.col("n_second") == 0), "clean")
        .when((F.col("n_first") >= 1) & (F.col("n_second") >= 1), "mixed")
        .when((F.col("n_second") >= 2) & (F.col("n_first") == 0), "non_eu")
        .otherwise("uncertain")
    )
    return found.withColumn("label", label)


def with_artefacts(lines: DataFrame) -> DataFrame:
    return lines.select("*", *[F.col("line").rlike(p).alias(n) for n, p in ARTEFACTS.items()])


def line_class(line) -> object:
    """Blank, a source header, or content."""
    header = r"^.+: \d[\d,]* lines [→\-]+ sampling \d[\d,]* lines$"
    return F.when(text.strip(line) == "", "blank").when(line.rlike(header), "header").otherwise("content")


def pct(n, d) -> object:
    return F.when(d > 0, F.round(100.0 * n / d, 3)).otherwise(0.0)


def duplicate_clusters(lines: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct lines, lines in clusters and their share, by scope."""
    counts = lines.groupBy(*scope, "line").agg(F.count("*").alias("c"))
    out = counts.groupBy(*scope).agg(F.sum("c").alias("lines"), F.count("*").alias("distinct_lines"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("dup_lines"))
    return out.withColumn("dup_pct", pct(F.col("dup_lines"), F.col("lines")))


def length_summary(lines: DataFrame, scope: list[str]) -> DataFrame:
    """Mean, middle, the element at floor(0.95 (n - 1)) and the largest length; quantiles come
    from a histogram of lengths, so no group's lines are gathered or sorted."""
    hist = lines.select(*scope, F.length("line").alias("len")).groupBy(*scope, "len").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*scope).orderBy("len")
    whole = Window.partitionBy(*scope)
    hist = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(whole))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("len")))
    return hist.groupBy(*scope).agg(
        F.first("n").alias("n"), F.round(F.sum(F.col("len") * F.col("c")) / F.sum("c"), 2).alias("avg_len"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median_len"),
        at(F.floor(0.95 * (F.col("n") - 1))).alias("p95_len"), F.max("len").alias("max_len"),
    )


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def phase2(lines: DataFrame, how: text.Cleaning = text.Cleaning()) -> DataFrame:  # noqa: B008
    """``cleaned, tag`` of each line, without document-wide repeats and splitting. A line is cleaned
    once: its cleaned form, what is left of it and the reason are bound one after the other."""

    def judged(x, left):
        reason = text.discard_reason(x, left) if how.digits else F.lit(None).cast("string")
        tag = text.let(
            reason,
            lambda r: F.when(x == "", "discard").when(r.isNotNull(), r).when(text.emoji_ratio(left) > how.max_emoji, "discard")
            .when(F.length(left) > how.longest_line, "discard").when(F.length(left) > how.long_line, "warn"),
        )
        return F.struct(left.alias("cleaned"), tag.alias("tag"))

    left_of = text.strip_decrees if how.digits else (lambda x: x)
    both = text.let(text.phase2_prefix(F.col("line"), how), lambda x: text.let(left_of(x), lambda left: judged(x, left)))
    return lines.withColumn("_both", both).select(*lines.columns, "_both.cleaned", "_both.tag")


def dry_run(lines: DataFrame, first: int, how: text.Cleaning = text.Cleaning()) -> DataFrame:  # noqa: B008
    """The first lines of each document with the tag that cleaning would give them, dropped ones as they
    were; nothing is written."""
    x = phase2(lines.filter(F.col("line_no") < first), how)
    dropped = F.col("tag").isNotNull() & (F.col("tag") != "warn")
    shown = F.when(dropped, F.concat(F.lit("<<dropped>> "), F.left("line", F.lit(160)))).otherwise(F.left("cleaned", F.lit(240)))
    return x.select("doc_id", "line_no", F.coalesce("tag", F.lit("keep")).alias("tag"), shown.alias("cleaned"))


def dedup_in_document(df: DataFrame, line: str) -> DataFrame:
    return keep_first(df, ["doc_id", F.lower(text.strip(F.col(line)))], ["line_no"])


def phase2_exact(docs: DataFrame) -> DataFrame:
    """The second cleaner with its shared seen-set: parents are cleaned, then split, and every
    sub-sentence is cleaned again. Cleaning stays in column expressions and is done once a line;
    only the ordered suppression of repeats walks each document's rows, which bounds its state."""
    how = text.Cleaning(whole_table=True)
    lines = phase2(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), how)
    parts = F.when(F.regexp_count("cleaned", F.lit(text.BOUNDARY)) >= 2, text.split_boundaries(F.col("cleaned"))).otherwise(F.array().cast("array<string>"))
    # The line itself comes first, as sub-sentence -1.
    rows = lines.drop("line").withColumn("parts", parts).withColumn("split", F.size("parts") > 0).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "parts")).alias("at", "line"))
    rows = phase2(rows.select("doc_id", "line_no", (F.col("at") - 1).alias("sub_no"), "split", F.struct("cleaned", "tag").alias("own"), "line"), how)
    mine = F.when(F.col("sub_no") < 0, F.col("own")).otherwise(F.struct("cleaned", "tag"))
    rows = rows.select("doc_id", "line_no", "sub_no", mine.alias("x"), "split").select("doc_id", "line_no", "sub_no", "x.cleaned", "x.tag", "split")
    names = ["doc_id", "line_no", "sub_no", "cleaned", "tag"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, dropped = (), set(), set()
        for batch in batches:
            tags, shown = [], []
            for doc_id, line_no, sub_no, cleaned, tag, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc_id,) != now:
                    now, seen, dropped = (doc_id,), set(), set()
                if sub_no >= 0 and line_no in dropped:
                    tags.append(None)
                    shown.append(False)
                    continue
                if tag is None or tag == "warn":
                    key = cleaned.strip().lower()
                    tag = "repeated" if key in seen else tag
                    seen.add(key)
                    if tag != "repeated" and len(cleaned.split(None, 2)) < 2:
                        tag = "discard"
                if sub_no < 0 and tag not in (None, "warn"):
                    dropped.add(line_no)
                tags.append(tag)
                shown.append(sub_no >= 0 or not split or line_no in dropped)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tags, pa.string())], names=names).filter(pa.array(shown, pa.bool_()))

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "line_no", "sub_no").mapInArrow(fold, "doc_id long, line_no int, sub_no int, cleaned string, tag string")


#: Elements whose start hides paragraphs that begin inside, and elements that are paragraphs.
HIDING = frozenset("script style nav header footer aside form button".split())
PARAGRAPHS = frozenset("p li h1 h2 h3 h4 div".split())


class _Events(HTMLParser):
    """Tags and text of a page in order: ``(tag, +1)``, ``(tag, -1)`` and ``(text, 0)``."""

    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, int]] = []
        self.handle_starttag = lambda tag, attrs: self.found.append((tag, 1))
        self.handle_endtag = lambda tag: self.found.append((tag, -1))
        self.handle_data = lambda data: self.found.append((data, 0))


def paragraphs_of(page: str | None, least: int = 41) -> list[str]:
    """Texts of at least ``least`` characters between a paragraph's start and the next paragraph's start
    or end. Starts inside a hiding element don't count; what no end follows is left out."""
    events = _Events()
    events.feed(page or "")
    steps = [step if step and name in HIDING else 0 for name, step in events.found]
    hidden = accumulate(steps, lambda depth, step: max(0, depth + step), initial=0)
    next(hidden)
    starts = [step == 1 and name in PARAGRAPHS and not depth for (name, step), depth in zip(events.found, hidden, strict=True)]
    ends = [step == -1 and name in PARAGRAPHS for name, step in events.found]
    cuts = [k for k, cut in enumerate(map(operator.or_, starts, ends)) if cut]
    between = (" ".join(" ".join(text for text, step in events.found[a + 1 : b] if not step).split()) for a, b in pairwise(cuts) if starts[a])
    return [text for text in between if len(text) >= least]


def extract_paragraphs(pages: DataFrame) -> DataFrame:
    """``page_id, paragraphs`` of each page, by its tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf.page_id, "paragraphs": [paragraphs_of(x) for x in pdf.html]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, paragraphs array<string>")


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, pos, sentence``."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence")).withColumn("sentence", text.strip(F.col("sentence")))


def is_clean(s, least: int = 8, most: int = 30) -> object:
    """The cleanliness predicate of evaluation sentences."""
    n = F.size(text.words(s))
    marks = lambda m: F.length(s) - F.length(F.replace(s, F.lit(m), F.lit("")))
    return (
        n.between(least, most) & s.rlike(r"^\p{Lu}") & s.rlike("[.!?]$") & (s != F.upper(s)) & s.rlike(r"^[A-Za-zÀ-ÿ'’\- .,;:!?]+$")
        & (marks(".") <= 1) & (marks("!") <= 1) & (marks("?") <= 1) & ~F.substring(s, F.lit(1), F.length(s) - 1).contains(".")
    )


def midpoint_pairs(s: DataFrame) -> DataFrame:
    """Prompt and target of sentences of eight or more words, cut in the middle."""
    x = s.withColumn("_w", text.words(F.col("sentence"))).withColumn("_n", F.size("_w")).filter("_n >= 8")
    x = x.withColumn("prompt", F.array_join(F.slice("_w", 1, F.expr("_n div 2")), " ")).withColumn("target", F.array_join(F.slice("_w", F.expr("_n div 2 + 1"), F.col("_n")), " "))
    return x.withColumn("target_words", F.expr("_n - _n div 2")).filter((F.col("target_words").between(4, 12)) & (F.length("target") <= 70)).drop("_w", "_n")
