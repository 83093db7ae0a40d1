"""Mixing to target weights by soft membership.

A naive Bayes classifier, fitted on labelled rows, gives each document posteriors over
domains. Projected gradient descent then fits nonnegative rates, one a document, whose
expected token totals by domain match the targets: an iteration is one grouped sum over
a slim table. Steps are scaled by document length, so a document's rate is a fold of its
own posteriors over the residuals so far, and nothing but those few numbers is kept
between iterations. DataFrame and SQL expressions throughout.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACES, added, let, staged, words_of

ALPHA = 0.7


def keyword_model(
    docs: DataFrame, labels: DataFrame, domain: str = "lang", max_labelled: int = 10_000, keywords: int = 192, smooth: float = 0.5
) -> tuple[list[str], dict[str, float], dict[str, list[float]]]:
    """Domains, log priors and, by keyword, the log likelihoods in each domain.

    Fitted on at most about ``max_labelled`` documents that ``labels(doc_id)`` lists, by
    the ``domain`` column that those documents carry: every value that one of them has is a
    domain, so the sample bounds their number. Keywords are the ``keywords`` words found in
    most of the sampled documents. Without such rows there are no domains.
    """
    known = labels.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()
    count = known.count()
    if not count:
        return [], {}, {}
    share = min(1.0, max_labelled / count)
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col(domain).cast("string").alias("_domain")).filter("_domain IS NOT NULL")
    rows = rows.join(F.broadcast(known), "doc_id")  # bounded: about max_labelled ids
    words = rows.select("_domain", F.explode(F.array_distinct(F.transform(words_of(F.col("text")), F.lower))).alias("w"))
    counts = staged(words.groupBy("_domain", "w").agg(F.count("*").alias("n")), "domain-words")
    sizes = {r[0]: r[1] for r in rows.groupBy("_domain").agg(F.count("*")).collect()}  # at most a row a labelled document
    domains = sorted(sizes)
    if not domains:
        return [], {}, {}
    top = counts.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(keywords)
    table: dict[str, dict[str, int]] = {r["w"]: {} for r in top.collect()}
    for r in counts.join(F.broadcast(top.select("w")), "w").collect():  # at most keywords * domains rows
        table[r["w"]][r["_domain"]] = r["n"]
    whole = sum(sizes.values())
    prior = {d: math.log(sizes[d] / whole) for d in domains}
    like = {w: [math.log((by.get(d, 0) + smooth) / (sizes[d] + 2 * smooth)) for d in domains] for w, by in table.items()}
    return domains, prior, like


def posteriors(words: Column, model: tuple[list[str], dict[str, float], dict[str, list[float]]], evidence: float = 12.0) -> Column:
    """Posterior of each domain for an array of lower-case words.

    A long text's log likelihood is averaged and counted as ``evidence`` words, so that
    membership stays soft; a text without keywords has the prior.
    """
    domains, prior, like = model
    size = len(domains)
    spots = {w: k for k, w in enumerate(like)}
    flat = F.array(*[F.lit(float(x)) for w in like for x in like[w]]) if like else F.array().cast("array<double>")
    place = F.create_map(*[x for w, k in spots.items() for x in (F.lit(w), F.lit(k))]) if like else None
    if not domains:
        return F.array().cast("array<double>")
    zero = F.array(*[F.lit(0.0)] * size)
    base = F.array(*[F.lit(float(prior[d])) for d in domains])
    if not like:
        summed, n = zero, F.lit(0)
    else:
        hits = F.filter(words, lambda w: w.isin(*spots))
        # counts by keyword: equal words are adjacent once sorted, so each run is scored once
        runs = let(
            F.sort_array(hits),
            lambda s: F.filter(
                F.transform(s, lambda w, i: F.when(F.coalesce(F.get(s, i - 1) != w, F.lit(True)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()
            ),
        )
        n = F.size(hits)
        weights = let(
            runs,
            lambda r: F.transform(r, lambda x, k: F.struct(F.element_at(place, x["w"]).alias("k"), (F.coalesce(F.get(r, k + 1)["i"], n) - x["i"]).cast("double").alias("c"))),
        )
        summed = F.aggregate(
            weights, zero, lambda a, x: F.array(*[F.get(a, F.lit(d)) + x["c"] * F.get(flat, x["k"] * size + d) for d in range(size)])
        )
    scaled = F.zip_with(summed, base, lambda s, b: b + s * F.least(F.lit(1.0), F.lit(evidence) / F.greatest(n, F.lit(1))))
    return let(
        let(scaled, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))),
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda x: x / t)),
    )


def _dot(p: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def rate_of(p: Column, steps: list[list[float]], floor: float = 0.0) -> Column:
    """The rate of a document with posteriors ``p`` after the given gradient steps."""
    if not steps:
        return F.lit(1.0)
    past = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return F.aggregate(past, F.lit(1.0), lambda r, g: F.greatest(F.lit(float(floor)), r - _dot(p, g)))


def fit_rates(slim: DataFrame, targets: list[float], floor: float = 0.0, rounds: int = 60, tolerance: float = 1e-3) -> list[list[float]]:
    """Gradient steps for ``slim(_p, _n)``: least squares of the domain totals against
    ``targets`` (tokens), each residual measured by the domain's size at rate one.

    Steps end when each total is within ``tolerance`` of its target. If ``rounds`` steps don't
    bring them there (targets that no rates above the floor can meet), a warning gives what is
    left, and the rates are those of the last step.
    """
    size = len(targets)
    sums = lambda rate: slim.select("_p", (rate * F.col("_n")).alias("_r")).agg(*[F.sum(F.col("_r") * F.get("_p", F.lit(d))) for d in range(size)]).first()
    ones = sums(F.lit(1.0))
    scale = [max(float(x or 0.0), 1e-9) for x in ones]
    steps: list[list[float]] = []
    now = [float(x or 0.0) for x in ones]
    # Soft members share their tokens among domains; the row sums of the scaled normal matrix are 1, so unit steps descend.
    for _ in range(rounds):
        error = [(now[d] - targets[d]) / scale[d] for d in range(size)]
        if max(abs(now[d] - targets[d]) / max(targets[d], 1e-9) for d in range(size)) < tolerance:
            break
        steps.append(error)
        now = [float(x or 0.0) for x in sums(rate_of(F.col("_p"), steps, floor))]
    else:
        left = max(abs(now[d] - targets[d]) / max(targets[d], 1e-9) for d in range(size))
        if left >= tolerance:
            warnings.warn(f"after {rounds} steps a domain total is {left:.2%} from its target", stacklevel=2)
    return steps


def _membership(text: Column, model) -> Column:
    """Number of words and posteriors of one text, which is split once."""
    text = F.lower(F.coalesce(text.cast("string"), F.lit("")))

    def both(words):
        # only the first and the last piece of a split can be empty
        n = F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
        return F.struct(n.cast("long").alias("n"), posteriors(words, model).alias("p"))

    return let(F.split(text, SPACES), both)


def mixed(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang", alpha: float = ALPHA, keep_text: bool = True, floor: float = 0.0
) -> tuple[DataFrame, list[str]]:
    """``docs`` (with ``keep_text`` off, without ``text``) with ``_n`` (words), ``_p``
    (posteriors, in the order of the domains returned) and ``_rate``. Where ``docs`` has a
    column of such a name, the added one has an underscore more (``common.added``).

    ``weights`` are target shares of the token total by domain; by default shares are
    the expected ones to the power ``alpha``, which lifts small domains. The total is
    set so that no domain has to shrink, and no rate goes below ``floor``: rates say how
    often a document is taken. Null and empty texts have no tokens and the prior's
    posteriors; repeated rows and null ids are rows like any other; with no labelled
    rows each rate is 1 and ``_p`` is empty. Columns of the input stay.
    """
    model = keyword_model(docs, labels, domain)
    domains = model[0]
    kept = [c for c in docs.columns if keep_text or c != "text"]
    n, p, rate = added(docs.columns, "_n", "_p", "_rate")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _membership(F.col("text"), model).alias("m"))
    marked = staged(inner, "memberships")  # texts are split and scored once
    shown = lambda r: marked.select("row.*", F.col("m.n").alias(n), F.col("m.p").alias(p), r.alias(rate))
    if not domains:
        return shown(F.lit(1.0)), []
    slim = marked.select(F.col("m.n").alias("_n"), F.col("m.p").alias("_p"))
    have = slim.agg(*[F.sum(F.col("_n") * F.get("_p", F.lit(d))) for d in range(len(domains))]).first()
    have = [float(x or 0.0) for x in have]
    share = [float((weights or {}).get(d, 0.0)) for d in domains] if weights else [x**alpha for x in have]
    if not sum(have) or not sum(share):
        return shown(F.lit(1.0)), domains
    share = [x / sum(share) for x in share]
    whole = max((h / s for h, s in zip(have, share, strict=True) if s), default=sum(have))
    steps = fit_rates(slim, [whole * s for s in share], floor)
    return shown(rate_of(F.col("m.p"), steps, floor)), domains


def taken(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with each row repeated as its rate says: the whole part, and one more if a
    hash of the row falls below the fraction. No rate goes below 1, so no document is
    thinned out. Columns as given."""
    rated, _ = mixed(docs, labels, floor=1.0, **how)
    rate, copy = added(docs.columns, "_n", "_p", "_rate")[2], added(rated.columns, "_copy")[0]
    chance = F.pmod(F.xxhash64(F.lit("take"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]), F.lit(1 << 30)) / float(1 << 30)
    copies = let(F.col(rate), lambda r: (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int"))
    # a rate is computed once: no filter on it that Spark would push below the repetition
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(True), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
