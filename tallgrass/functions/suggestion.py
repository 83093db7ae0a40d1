"""Column builders for suggestions: words at the cursor, garbage, stops, chunks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrass.functions.text import BLANK, PUNCTUATION, let, strip

# Punctuation that is no part of a word, with quotes.
MARKS = PUNCTUATION + "\"'"


def has_garbage(x: Column) -> Column:
    """Characters beyond Latin-1, which only stray bytes make."""
    return x.rlike(r"[^\x{00}-\x{FF}]")


def is_punctuation(x: Column) -> Column:
    return strip(x).rlike(r"^[.!,?;:()\[\]{}]+$")


def has_digit(x: Column) -> Column:
    return x.rlike(r"\d")


def cut_at_stops(x: Column, stops: list[str]) -> Column:
    """Up to the first stop of the list that is in the text, wherever in the text it is."""
    out = x
    for stop in reversed([s for s in stops if s]):
        out = F.when(x.contains(stop), F.substring_index(x, stop, 1)).otherwise(out)
    return out


def clean_chunk(x: Column) -> Column:
    """A streamed piece without word marks and stray bytes."""
    return F.replace(F.replace(x, F.lit("▁"), F.lit(" ")), F.lit("�"), F.lit(""))


def current_word(x: Column) -> Column:
    """The word that the text ends in, '' after white space."""
    return F.regexp_extract(x, r"(\S*)\z", 1)


def before_word(x: Column) -> Column:
    return F.left(x, F.length(x) - F.length(current_word(x)))


def first_word(x: Column) -> Column:
    """The word that the text begins with, without marks at its end; '' before white space."""
    return F.regexp_replace(F.regexp_extract(x, r"^(\S*)", 1), r"[.!,?;:()\[\]{}]+$", "")


def bare_word(x: Column) -> Column:
    """Lower case without marks around, for comparison."""
    return F.btrim(F.lower(x), F.lit(MARKS))


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(strip(t) != "", t) for t in texts], F.lit(""))


def finish_reason(used: Column, most: Column) -> Column:
    return F.when(used >= most, "length").otherwise("stop")


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def around_cursor(x: Column, cursor: Column, before: int, after: int) -> tuple[Column, Column]:
    """Up to ``before`` characters left of the cursor and ``after`` right of it."""
    start = F.greatest(F.lit(0), cursor - before)
    return F.substring(x, start + 1, cursor - start), F.substring(x, cursor + 1, F.lit(after))


def normal_prompt(x: Column) -> Column:
    """The prompt of a JSON field: a text, ids joined by spaces, or the first of a batch of texts."""
    kind = F.schema_of_variant(x)
    first = F.try_variant_get(x, "$[0]", "string")
    ids = F.array_join(F.transform(F.try_variant_get(x, "$", "array<long>"), lambda i: i.cast("string")), " ")
    return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind == "ARRAY<BIGINT>", ids).when(kind.startswith("ARRAY"), F.coalesce(first, F.lit(""))).otherwise("")


def visual_tokens(pieces: Column) -> Column:
    """What a piece shows, and whether a space stands before it."""
    marked = lambda p: p.startswith("▁")
    shown = lambda p: F.when(p == "▁", " ").when(marked(p), F.substring(p, F.lit(2), F.length(p))).otherwise(p)
    return F.transform(pieces, lambda p: F.struct(shown(p).alias("token"), marked(p).alias("space_before")))


def decoded(raw: Column) -> Column:
    """Bytes of a token as text, stray ones replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def repaired(path: Column) -> Column:
    """Digit repair of a greedy path ``array<struct<text, others array<string>>>``: a text with a digit (at
    the start also a blank one) gives way to its first other without one. Where none is left the path
    ends before it. Struct of the texts and of the first place that changed (-1: none)."""
    usable = lambda t: ~has_digit(t) & (strip(t) != "")
    bad = lambda x, i: has_digit(x["text"]) | ((i == 0) & (strip(x["text"]) == ""))
    fixed = F.transform(path, lambda x, i: F.when(bad(x, i), F.get(F.filter(x["others"], lambda t: usable(t) & (t != x["text"])), F.lit(0))).otherwise(x["text"]))
    end = let(fixed, lambda f: F.coalesce(F.nullif(F.array_position(F.transform(f, lambda t: t.isNull()), True), F.lit(0)) - 1, F.size(f)))
    changed = F.array_position(F.transform(path, bad), True) - 1
    return F.struct(F.slice(fixed, F.lit(1), end.cast("int")).alias("texts"), F.when(changed < end, changed).otherwise(F.lit(-1)).cast("int").alias("first_swap"))


def is_structural(x: Column) -> Column:
    return x.rlike("<XBU>|<XBC>|<XEC>|<CHAR_")


def plausible(word: Column, among: Column, least: int = 2) -> Column:
    """Whether a word equals one of a set, or is the start of one or one its, from ``least`` letters on."""
    w = F.btrim(F.lower(word), F.lit("▁<>"))
    same = lambda p: (w == F.lower(p)) | ((F.length(w) >= least) & (F.lower(p).startswith(w) | w.startswith(F.lower(p))))
    return (w != "") & ~is_structural(word) & F.exists(among, same)


def accepted(editor: Column, cursor: Column, chip: Column, is_next: Column) -> Column:
    """Struct of the editor's text and the cursor after a chip is taken: a next word goes in between
    spaces, a mark takes the place of a space before it, a word that of the one being typed."""
    left, right = F.left(editor, cursor), F.substring(editor, cursor + 1, F.length(editor))
    spaced = F.when(chip.rlike(f"{BLANK}$"), chip).otherwise(F.concat(chip, F.lit(" ")))
    head = F.when(is_next, left).when(is_punctuation(chip), F.when(left.endswith(" "), F.left(left, F.length(left) - 1)).otherwise(left)).otherwise(before_word(left))
    put = F.when(is_next, F.concat(F.lit(" "), chip, F.lit(" "))).when(is_punctuation(chip), F.concat(strip(chip), F.lit(" "))).otherwise(spaced)
    return F.struct(F.concat(head, put, right).alias("editor"), (F.length(head) + F.length(put)).alias("cursor"))
