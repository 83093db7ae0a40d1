"""Quality rules: base statistics of a text, and a decision list learned from labels.

Everything is a DataFrame or SQL expression. Sequential covering works on a staged
table of labelled statistics: each step is one grouped count over (feature, bin), so
the driver sees at most ``features * bins`` rows a step, whatever the corpus holds.
The learned list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACES, added, let, staged, total, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
DIGITS = "0123456789"

#: Ratios that the learned conditions may test, over the base statistics.
FEATURES = {
    "symbols_per_word": "_n_symbols / greatest(_n_words, 1)",
    "upper_share": "_n_upper / greatest(_word_chars, 1)",
    "digit_share": "_n_digits / greatest(_word_chars, 1)",
    "bangs_per_word": "_n_bangs / greatest(_n_words, 1)",
    "chars_per_word": "_word_chars / greatest(_n_words, 1)",
    "dup_line_share": "_n_dup_lines / greatest(_n_lines, 1)",
    "repeat_share": "_n_repeat_words / greatest(_n_words, 1)",
    "distinct_share": "_n_distinct / greatest(_n_words, 1)",
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from word hashes.

    Windows are sorted by (hash, position); those equal to a neighbour are repeats,
    and the union of their three-word spans is a sum of capped gaps.
    """

    def windows(h):
        spots = F.sequence(F.lit(0), F.size(h) - 3)
        return F.sort_array(F.transform(spots, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s):
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        hits = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(p):
        return total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))

    found = let(hashes, lambda h: let(windows(h), lambda s: let(repeated(s), covered)))
    return F.when(F.size(hashes) >= 3, found).otherwise(F.lit(0).cast("long"))


#: Columns that ``with_statistics`` and ``judged`` add.
STATISTICS = ("_n_words", "_word_chars", "_n_symbols", "_n_lines", "_n_dup_lines", "_n_repeat_words", "_n_distinct", "_n_upper", "_n_digits", "_n_bangs")
VERDICTS = ("_base_failed", "_rule", "_kept")


def _inner(docs: DataFrame) -> DataFrame:
    """``row``, the columns of ``docs`` as one, and the statistics of its text beside it."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    first = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    first = first.withColumn("_hashes", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    return (
        first.withColumn("_n_words", F.size("_hashes").cast("long"))
        .withColumn("_word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("_n_symbols", _count_of(text, SYMBOLS))
        .withColumn("_n_lines", F.size(lines).cast("long"))
        .withColumn("_n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("_n_repeat_words", _repeat_words(F.col("_hashes")))
        .withColumn("_n_distinct", F.size(F.array_distinct("_hashes")).cast("long"))
        .withColumn("_n_upper", _count_of(text, UPPER))
        .withColumn("_n_digits", _count_of(text, DIGITS))
        .withColumn("_n_bangs", _count_of(text, "!"))
        .drop("_hashes", "_text")
    )


def _outer(inner: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return inner.select("row.*", *[F.col(a).alias(b) for a, b in zip(names, added(docs.columns, *names), strict=True)])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``STATISTICS``, counts of its ``text``, null counting as empty. Where
    ``docs`` has a column of such a name, the added one has an underscore more."""
    return _outer(_inner(docs), docs, STATISTICS)


def base_failed() -> Column:
    return F.expr("_n_words < 50 OR 100 * _n_repeat_words > 50 * _n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self, column: str | None = None) -> str:
        return f"({column or FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self, by_name: bool = False) -> str:
        return " AND ".join(c.sql(c.feature if by_name else None) for c in self.conditions)


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts the value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: value > cut))


def _grow(rows: DataFrame, names: list[str], grid: dict[str, list[float]], depth: int) -> tuple[Condition, ...]:
    """Adds the threshold of best FOIL gain until no negative is left or nothing gains."""
    rule: list[Condition] = []
    for _ in range(depth):
        here = rows.filter(" AND ".join(c.sql(c.feature) for c in rule) or "true")
        bins = F.array(*[F.struct(F.lit(n).alias("feature"), _bin(F.col(n), grid[n]).alias("bin")) for n in names if grid[n]])
        counts = here.select("bad", F.explode(bins).alias("x")).groupBy("x.feature", "x.bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        ).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
        if not by:
            break
        p0, n0 = (sum(v[i] for v in next(iter(by.values())).values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in sorted(by):
            for k, t in enumerate(grid[name]):
                up = [sum(v[i] for b, v in by[name].items() if b > k) for i in (0, 1)]
                for above, (p, n) in ((True, up), (False, [p0 - up[0], n0 - up[1]])):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, t))
        if best[1] is None:
            break
        rule.append(best[1])
    return tuple(rule)


def _prune(rows: DataFrame, rule: tuple[Condition, ...]) -> Rule:
    """Cuts final conditions where that raises (p - n) / (p + n) on the pruning rows."""
    heads = [rule[: k + 1] for k in range(len(rule))]
    sums = []
    for k, head in enumerate(heads):
        hit = " AND ".join(c.sql(c.feature) for c in head)
        sums += [F.expr(f"sum(CASE WHEN {hit} THEN bad ELSE 0 END)").alias(f"p{k}"), F.expr(f"sum(CASE WHEN {hit} THEN 1 - bad ELSE 0 END)").alias(f"n{k}")]
    got = rows.agg(*sums).first()
    score = []
    for k, head in enumerate(heads):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        score.append((((p - n) / (p + n)) if p + n else -1.0, -k, Rule(head, p / (p + n) if p + n else 0.0, p + n)))
    return max(score, key=lambda x: x[:2])[2]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 40_000,
    max_rules: int = 8,
    depth: int = 3,
    precision: float = 0.98,
    bins: int = 24,
) -> list[Rule]:
    """An ordered list of rules for label 0 (bad) from ``labels(doc_id, quality)``.

    The classifier is fitted on at most about ``max_labelled`` labelled documents, taken
    by a hash of doc_id. Rows without doc_id or label are left out; of repeated labels
    the smaller counts. Rules are grown on two thirds of the rows and pruned on the rest,
    and one that falls short of ``precision`` there ends the search, so that clean
    documents stay. Without labels, or without both classes, the list is empty.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_quality")).filter(
        "doc_id IS NOT NULL AND _quality IN (0, 1)"
    )
    count = known.count()
    if not count:
        return []
    share = min(1.0, max_labelled / count)
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = known.groupBy("doc_id").agg(F.min("_quality").alias("_quality"))  # bounded: about max_labelled ids
    rows = with_statistics(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id"))
    rows = staged(
        rows.filter(~base_failed()).select(
            (1 - F.col("_quality")).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("pruning"),
            *[F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()],
        ),
        "labelled-statistics",
    )
    names = list(FEATURES)
    cuts = [i / bins for i in range(1, bins)]
    # Bad rows are a minority: thresholds come from the quantiles of either class.
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(n, cuts, 2000).alias(n) for n in names]).collect()
    if len(quantiles) < 2:
        return []
    grid = {n: sorted({round(float(q), 6) for r in quantiles for q in (r[n] or [])}) for n in names}
    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        grown = _grow(left.filter("NOT pruning"), names, grid, depth)
        if not grown:
            break
        rule = _prune(left.filter("pruning"), grown)
        if rule.precision < precision or rule.covered < 3:
            break
        rules.append(rule)
        left = left.filter(f"NOT ({rule.sql(by_name=True)})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(rules, 1)) + " END").cast("int")


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` with its statistics, ``_base_failed``, the
    ``_rule`` that rejects it (or null) and ``_kept``; where ``docs`` has a column of such a
    name, the added one has an underscore more. No row is dropped, joined or
    repeated: null ids, repeated rows and further columns pass through; null text counts
    as empty and so fails the base rules; an empty table stays empty."""
    rules = learn(docs, labels, **how)
    marked = _inner(docs).withColumn("_base_failed", base_failed()).withColumn("_rule", verdict(rules))
    return _outer(marked.withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull()), docs, STATISTICS + VERDICTS)


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, columns as given."""
    return judged(docs, labels, **how).filter(F.col(added(docs.columns, *STATISTICS, *VERDICTS)[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
