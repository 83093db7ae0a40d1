"""Column builders for line cleaning and suggestion repair.

Word characters are written out as letters, digits and underscore, so that a pattern
means the same in any regular-expression dialect.
"""

from __future__ import annotations

import html
import html.entities
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]"
EMOJI = r"[\x{2500}-\x{27BF}\x{1F000}-\x{1FFFF}]"
SYMBOL = r"[\x{2500}-\x{27BF}]"
MODIFIER = r"(?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}]|\x{200D}[\x{1F000}-\x{1FFFF}])*"
# Legal references, sentence boundaries and orphan dates of the cleaning rules.
DECREE = (
    r"\b\d{1,4}/\d{1,4}(?:\s*/\s*\d{1,4})*(?:\s*(?:legea|legean|legearen|legeak|legeetarako|autoak|autoetan|dekretua|dekretuaren|dekretuak"
    r"|ebazpena|ebazpenaren|epaia|epaiaren|agindua|aginduaren|erregelamendua|erregelamenduaren|artikulua|artikuluaren|artikuluan|artikuluak"
    r"|atala|atalaren|idazpurua|kapitulua))?|\b\d{1,4}\s+(?:ter|bis|quater)\s+artikulua\b"
)
BOUNDARY = r"(?<=[a-záéíóúüñ])([.?!])\s+(?=[A-ZÁÉÍÓÚÜÑ])"
ORPHAN_DATE = r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\s*([|]\s*\d+\s*\w+)?\s*$"
PUNCTUATION = ".!,?;:()[]{}"
PUNCTUATION_RUN = r"([!?¿¡_—–.-])\1{2}|([,;:&])\2"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sub(x: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(x, pattern, to)


def _guarded(x: Column, signs: str, change: Callable[[Column], Column]) -> Column:
    """``change`` where one of the signs is in the text; most lines have none and need no pattern."""
    return let(x, lambda v: F.when(F.translate(v, signs, "") == v, v).otherwise(change(v)))


def strip(x: Column) -> Column:
    """Without white space (of any kind) at either end."""
    return _sub(x, f"^{BLANK}+|{BLANK}+$")


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"{BLANK}+"), lambda w: w != "")


def has_two_words(x: Column) -> Column:
    """Whether white space stands between other characters: a look, where ``words`` would build an array."""
    return x.rlike(f"[^{BLANK[1:-1]}]{BLANK}+[^{BLANK[1:-1]}]")


def strip_urls(x: Column, any_case: bool = True) -> Column:
    return _sub(x, ("(?i)" if any_case else "") + r"https?://\S+")


def strip_emails(x: Column) -> Column:
    return _sub(x, r"\S+@\S+\.\S+")


def strip_mentions(x: Column, bounded: bool = True) -> Column:
    return _sub(x, (f"(?<!{W})" if bounded else "") + f"@{W}+")


def clean_hashtags(x: Column, bounded: bool = True, least: int = 7) -> Column:
    """The bare word of a long tag; short tags go."""
    before = f"(?<!{W})" if bounded else ""
    return _sub(_sub(x, f"{before}#({W}{{{least},}})(?!{W})", "$1"), f"{before}#{W}+")


def collapse_punctuation(x: Column) -> Column:
    for pattern, to in ((r"([!?¿¡])\1{2,}", "$1$1"), (r"([,;:&])\1+", "$1"), (r"([-_])\1{2,}", "$1$1"), (r"\.{4,}", "..."), (r"([—–])\1{2,}", "$1")):
        x = _sub(x, pattern, to)
    return x


def collapse_emoji(x: Column, astral: bool = True) -> Column:
    """Runs of three or more sequences with one base keep two. Without ``astral`` (the second cleaner)
    only symbols up to U+27BF begin a sequence, and emoji beyond them belong to the one before."""
    base, more = (EMOJI, MODIFIER) if astral else (SYMBOL, r"[\x{FE0F}\x{200D}\x{1F000}-\x{1FFFF}]*")
    return let(x, lambda v: F.when(v.rlike(base), _sub(v, rf"(({base}){more})(\2{more})(?:\2{more})+", "$1$3")).otherwise(v))


def emoji_ratio(x: Column) -> Column:
    return let(x, lambda v: F.when(v.rlike(EMOJI), 1 - F.length(_sub(v, EMOJI + MODIFIER)) / F.length(v)).otherwise(0.0))


def collapse_spaces(x: Column) -> Column:
    return strip(_sub(x, " {2,}", " "))


_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _table(found: dict[str, str]) -> Column:
    """A constant map, parsed once when the query is planned."""
    return F.from_json(F.lit(json.dumps(found)), "map<string,string>")


def _odd_numbers() -> dict[str, str]:
    """Numbers that stand for something other than their code point, as the standard's own function says."""
    odd = [*range(160), *range(0xFDD0, 0xFDF0), *(p + e for p in range(0, 0x110000, 0x10000) for e in (0xFFFE, 0xFFFF))]
    return {str(n): c for n in odd if (c := html.unescape(f"&#{n};")) != chr(n)}


def unescaped(x: Column) -> Column:
    """Character references of the whole HTML table, in one pass: names with or without their semicolon (the
    longest that is one), decimal and hexadecimal numbers. Lines without an ampersand are left alone."""
    names, numbers = _table(html.entities.html5), _table(_odd_numbers())

    def number(ref: Column) -> Column:
        raw = F.regexp_extract(ref, "^#(?:[xX])?0*([0-9a-fA-F]*);?$", 1)
        code = F.when(raw == "", 0).when(ref.rlike("^#[xX]"), F.conv(raw, 16, 10).try_cast("long")).otherwise(raw.try_cast("long"))
        whole = let(code, lambda n: F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.coalesce(F.element_at(numbers, n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))))
        return F.when(F.length(raw) > 8, "\ufffd").otherwise(whole)

    def name(ref: Column) -> Column:
        lengths = F.when(F.length(ref) > 2, F.sequence(F.length(ref) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        shorter = F.filter(lengths, lambda n: F.map_contains_key(names, F.left(ref, n)))
        cut = let(F.get(shorter, F.lit(0)), lambda n: F.concat(F.element_at(names, F.left(ref, n)), F.substring(ref, n + 1, F.length(ref))))
        return F.coalesce(F.element_at(names, ref), cut, F.concat(F.lit("&"), ref))

    def changed(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(_REFERENCE), F.lit(1)), lambda r: F.when(r.startswith("#"), number(r)).otherwise(name(r)))
        return F.array_join(F.zip_with(F.split(v, _REFERENCE, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return _guarded(x, "&", changed)


def strip_tags(x: Column, whole_table: bool = False) -> Column:
    """Character references of the common set, or of the whole table, then tags."""
    if whole_table:
        return _sub(unescaped(x), "<[^>]*>")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return _sub(x, "<[^>]*>")


def strip_decrees(x: Column) -> Column:
    x = collapse_spaces(_guarded(x, "0123456789", lambda v: _sub(v, DECREE)))
    for pattern, to in ((r"^[,;:.\s]+", ""), (r"[,;:]\s*[.]", "."), (r"\s+[.]\s*$", "."), (r"\s+[,;:]\s*$", "")):
        x = _sub(x, pattern, to)
    return strip(x)


def digit_token_ratio(x: Column) -> Column:
    return let(words(x), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda t: t.rlike(r"\d"))) / F.size(w)).otherwise(0.0))


def digit_char_ratio(x: Column) -> Column:
    return F.when(F.length(x) > 0, (F.length(x) - F.length(F.translate(x, "0123456789", ""))) / F.length(x)).otherwise(0.0)


def is_pure_number(x: Column) -> Column:
    alpha = F.size(F.filter(words(x), lambda w: 2 * F.length(_sub(w, r"[^\p{L}]")) > F.length(w)))
    share = digit_char_ratio(strip(x))
    return F.when(share > 0.5, ((share > 0.55) & (alpha <= 1)) | (alpha == 0)).otherwise(False)


def phase3(x: Column) -> tuple[Column, Column]:
    """The stripped line and the first reason to discard it (null: kept), each evaluated by itself."""
    return strip_decrees(x), let(x, lambda v: let(strip_decrees(v), lambda left: discard_reason(v, left)))


def discard_reason(x: Column, left: Column) -> Column:
    """The first reason to discard a line, given what is left of it without legal references. The reasons
    of digits are looked into where there is one, and words are listed only where enough are."""
    n = F.length(x) - F.length(F.translate(x, "0123456789", ""))
    of_digits = (
        F.when(is_pure_number(x), "digit_pure")
        .when(strip(x).rlike(ORPHAN_DATE), "digit_orphan_date")
        .when((n >= 7) & x.rlike(r"\d{7,}"), "digit_long_run")
        .when(digit_token_ratio(x) > 0.4, "digit_heavy_tokens")
        .when(digit_char_ratio(x) > 0.5, "digit_heavy_chars")
    )
    others = F.when(~has_two_words(left), "digit_decree_stripped").when(
        left.rlike(r"^\p{Ll}") & ~left.rlike("[.!?\"»]$") & ((F.length(left) < 50) | left.rlike("[,;-]$")), "orphan_fragment"
    )
    return F.coalesce(F.when(n > 0, of_digits), others)


def quick_clean(x: Column, max_emoji: float = 0.30) -> Column:
    """The quick cleaner: the line, or '' where it is discarded. Each step is evaluated once, and
    only where a sign that its pattern needs is in the line."""
    x = _guarded(x, ":", lambda v: strip_urls(v, any_case=False))
    x = _guarded(x, "@", lambda v: strip_mentions(strip_emails(v), bounded=False))
    x = _guarded(x, "#", lambda v: clean_hashtags(v, bounded=False))
    x = collapse_spaces(_collapsed(collapse_emoji(x)))
    return let(x, lambda v: F.when(~has_two_words(v) | (emoji_ratio(v) > max_emoji), "").otherwise(v))


def _collapsed(x: Column) -> Column:
    return let(x, lambda v: F.when(v.rlike(PUNCTUATION_RUN), collapse_punctuation(v)).otherwise(v))


@dataclass(frozen=True)
class Cleaning:
    """Steps of the second cleaner, each on unless told otherwise, and its thresholds."""

    urls: bool = True
    emails: bool = True
    mentions: bool = True
    hashtags: bool = True
    emoji: bool = True
    whole_table: bool = False  # character references of all names, not the common ones alone
    punctuation: bool = True
    tags: bool = True
    digits: bool = True
    max_emoji: float = 0.30
    long_line: int = 512
    longest_line: int = 2048


def phase2_prefix(x: Column, how: Cleaning = Cleaning()) -> Column:  # noqa: B008
    """The order-free part of the second cleaner, up to the digit rules."""
    steps = (
        (how.urls, lambda c: _guarded(c, ":", strip_urls)),
        (how.emails, lambda c: _guarded(c, "@", strip_emails)),
        (how.mentions, lambda c: _guarded(c, "@", strip_mentions)),
        (how.hashtags, lambda c: _guarded(c, "#", clean_hashtags)),
        (how.emoji, lambda c: collapse_emoji(c, astral=False)),
        (how.punctuation, _collapsed),
        (how.tags, lambda c: _guarded(c, "&<", lambda v: strip_tags(v, how.whole_table))),
    )
    for on, step in steps:
        x = step(x) if on else x
    return collapse_spaces(x)


def has_digit_run(x: Column, least: int = 7) -> Column:
    """Whether a run of ``least`` digits is in the line; 0 turns the rule off."""
    return x.rlike(rf"\d{{{least},}}") if least else F.lit(False)


def split_boundaries(x: Column, mis_stitched: bool = False) -> Column:
    """Sub-sentences; the mark stays with the sentence that it ends.

    ``mis_stitched`` joins the parts text, mark, text by threes, so that a sentence and the next are
    one line and what is left over stands alone, the second mark too.
    """
    if not mis_stitched:
        return F.split(_sub(x, BOUNDARY, "$1\u0001"), "\u0001")
    parts = F.split(_sub(x, BOUNDARY, "\u0001$1\u0001"), "\u0001")

    def by_threes(p: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 3).cast("int")), lambda i: F.slice(p, 3 * i + 1, F.lit(3)))
        joined = lambda t: F.array(F.concat(F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.lit(" "), F.get(t, F.lit(2))))
        lines = F.flatten(F.transform(groups, lambda t: F.when(F.size(t) == 3, joined(t)).otherwise(t)))
        return F.filter(F.transform(lines, strip), lambda x: x != "")

    return let(parts, by_threes)


def filter_suggestion(x: Column) -> Column:
    """Repairs a suggestion: markers, first newline, white space, mixed punctuation runs, dangling marks."""
    p = r"[.!,?;:()\[\]{}]"
    text = F.replace(F.replace(x, F.lit("▁"), F.lit(" ")), F.lit("�"), F.lit(""))
    tidy = _sub(_sub(_sub(text, f"{BLANK}+$"), f"{BLANK}+", " "), f"({p}){p}+", "$1")
    tidy = _sub(tidy, f"(?: {p}+)+$")
    return (
        F.when(text.startswith("\n"), "")
        .when(tidy.rlike(r"\p{L}") | (strip(tidy) == ""), tidy)
        .when(tidy.rlike(f"^{p}$"), tidy)
        .otherwise("")
    )


def ghost_suffix(text: Column, context: Column, suggestion: Column) -> Column:
    """What of a suggestion is new against the typed text that its context left out."""
    excluded = F.when(F.length(text) > F.length(context), F.substring(text, F.length(context) + 1, F.length(text))).otherwise("")
    last = F.right(text, F.lit(1))
    doubled = (last != "") & F.lit(PUNCTUATION).contains(last) & (F.left(suggestion, F.lit(1)) == last)
    s = F.when(doubled, F.substring(suggestion, F.lit(2), F.length(suggestion))).otherwise(suggestion)
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(excluded), F.length(s))))
    hit = F.array_max(F.filter(spots, lambda i: (F.length(excluded) > 0) & (F.lower(F.left(s, i)) == F.lower(F.right(excluded, i)))))
    return F.when(hit.isNull() | (s == ""), s).otherwise(F.substring(s, hit + 1, F.length(s)))


def prefix_match(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the place of the first character that differs, less one."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y) | (x == ""))
    return let(differs, lambda d: F.coalesce(F.nullif(F.array_position(d, True), F.lit(0)) - 1, F.size(d)).cast("int"))


def grouped_confidence(tokens: DataFrame, group: str, logprob: str) -> DataFrame:
    """``confidence`` of a row a token, as sums that combine map-side, so that no group is gathered."""
    p = F.col(logprob)
    real = F.when(p < -0.01, F.exp(p))
    means = tokens.groupBy(group).agg(F.count(p).alias("_n"), F.round(F.avg(real), 4).alias("_m"))
    return means.select(group, F.when(F.col("_n") == 0, 1.0).otherwise(F.coalesce("_m", F.lit(0.0))).alias("confidence"))


def confidence(tokens: Column) -> Column:
    """Mean probability over tokens with logprob under -0.01; none listed 1, none real 0."""
    real = F.transform(F.filter(tokens, lambda p: p < -0.01), F.exp)
    mean = F.round(F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.size(real), 4)
    return F.when(F.size(tokens) == 0, 1.0).when(F.size(real) == 0, 0.0).otherwise(mean)
