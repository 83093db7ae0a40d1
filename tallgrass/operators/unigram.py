"""Unigram subword encoding: the likeliest split of each word by the scores of a vocabulary.

A vocabulary is a model file or is counted from a table's words; nothing is trained. Its rows
are ``piece, score`` in the order of ids, a file of some thousands of pieces: special
pieces, 256 byte pieces, pieces that are never split, and all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import text

SPACE = "▁"
SPECIAL = ("<unk>", "<s>", "</s>")
BYTES = tuple(f"<0x{b:02X}>" for b in range(256))
_PENALTY = 10.0  # how much worse than the worst piece an unknown character is


@dataclass
class Vocabulary:
    """Pieces and scores by id. ``added`` pieces are matched first and never split; ``trie`` holds the others."""

    rows: list[tuple[str, float]]
    added: tuple[str, ...] = ()
    ids: dict[str, int] = field(init=False)
    trie: dict = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _) in enumerate(self.rows)}
        apart = {*SPECIAL, *BYTES, *self.added}
        self.bytes = [self.ids.get(b) for b in BYTES]
        self.fallback = None not in self.bytes
        self.unknown = self.ids.get(SPECIAL[0], 0)
        plain = [(p, s) for p, s in self.rows if p not in apart]
        self.floor = min((s for _, s in plain), default=0.0) - _PENALTY
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.trie = {}
        for p, s in plain:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (self.ids[p], s)

    def split(self, part: str) -> list[tuple[int, str]]:
        """Ids and pieces of the best split: of equal ones, that whose last pieces are longest. A character
        that begins no piece of its own may stand alone as unknown, as its bytes if there are byte pieces."""
        n = len(part)
        best: list[tuple[float, int, int] | None] = [(0.0, 0, 0), *[None] * n]
        for i in range(n):
            begun = best[i][0]
            node, j, alone = self.trie, i, False
            while j < n and (node := node.get(part[j])) is not None:
                j += 1
                if "" in node:
                    alone |= j == i + 1
                    piece, score = node[""]
                    if best[j] is None or begun + score > best[j][0]:
                        best[j] = (begun + score, i, piece)
            if not alone and (best[i + 1] is None or begun + self.floor > best[i + 1][0]):
                best[i + 1] = (begun + self.floor, i, -1)
        out: list[tuple[int, str]] = []
        j = n
        while j:
            _, i, piece = best[j]
            if piece >= 0:
                out.append((piece, part[i:j]))
            elif self.fallback:
                out += [(self.bytes[b], BYTES[b]) for b in reversed(part[i:j].encode())]
            elif out and out[-1][0] == self.unknown:  # unknown characters in a row are one piece
                out[-1] = (self.unknown, part[i:j] + out[-1][1])
            else:
                out.append((self.unknown, part[i:j]))
            j = i
        return out[::-1]

    def word(self, word: str) -> list[tuple[int, str]]:
        """A word with its mark."""
        marked = SPACE + word
        if self.marks is None:
            return self.split(marked)
        parts = self.marks.split(marked)
        return [x for k, p in enumerate(parts) if p for x in ([(self.ids[p], p)] if k % 2 else self.split(p))]


def encoded(texts: DataFrame, vocabulary: Vocabulary, column: str = "line", pieces: bool = False) -> DataFrame:
    """``texts`` with ``ids`` (or ``pieces``) of each text; null and blank texts have none. White space of
    any kind separates words and is kept as the mark before each alone."""
    which = int(pieces)

    @F.pandas_udf("array<string>" if pieces else "array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, list] = {}
        for part in parts:
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for x in part:
                row: list = []
                for w in (x or "").split():
                    found = memo.get(w)
                    if found is None:
                        found = memo[w] = [p[which] for p in vocabulary.word(w)]
                    row += found
                out.append(row)
            yield pd.Series(out)

    return texts.withColumn("pieces" if pieces else "ids", encode(F.col(column)))


def word_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """``w, n`` of a column's words."""
    return lines.select(F.explode(text.words(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def counted(words: DataFrame, size: int, longest: int = 6, added: tuple[str, ...] = (), byte_pieces: bool = True) -> Vocabulary:
    """A vocabulary of the ``size`` most frequent parts (ties by spelling) of counted ``w, n`` words marked at
    their begin: up to ``longest`` characters, a digit always by itself. Scores are logarithms
    of their shares. All that reaches the driver is ``size`` rows."""
    marked = F.concat(F.lit(SPACE), "w")
    starts = F.sequence(F.lit(1), F.length("m"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("m") - i + 1)), lambda k: F.substring("m", i, k))))
    found = words.select(marked.alias("m"), "n").select(F.explode(parts).alias("piece"), "n").filter(~F.col("piece").rlike(r"\d") | (F.length("piece") == 1))
    found = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    whole = found.agg(F.sum("n").alias("t"))
    rows = found.join(F.broadcast(whole)).select("piece", F.round(F.log(F.col("n") / F.col("t")), 6).alias("score"), "n").collect()
    rows = sorted(rows, key=lambda r: (-r.n, r.piece.encode()))
    apart = [*SPECIAL, *(BYTES if byte_pieces else ()), *added]
    return Vocabulary([*((p, 0.0) for p in apart), *((r.piece, r.score) for r in rows if r.piece not in apart)], added)


def checks(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row on counted words ``w, n``: ``size``; the special ids, and whether the end's is another than the
    unknown's; share of unknown pieces in percent, pieces a word, and the verdict on all."""
    x = encoded(words, vocabulary, "w").select("n", "ids")
    unknown = F.size(F.filter("ids", lambda i: i == vocabulary.unknown))
    pieces = F.sum(F.size("ids") * F.col("n"))
    special = [vocabulary.ids.get(p, -1) for p in SPECIAL]
    out = x.agg(F.coalesce(F.round(100.0 * F.sum(unknown * F.col("n")) / pieces, 4), F.lit(0.0)).alias("unk_rate"), F.round(pieces / F.sum("n"), 6).alias("fertility"))
    ends = special[2] not in (-1, special[0])
    out = out.select(F.lit(len(vocabulary.rows)).alias("size"), *[F.lit(i).alias(c) for c, i in zip(("unk_id", "bos_id", "eos_id"), special, strict=True)], F.lit(ends).alias("eos_ok"), "*")
    out = out.withColumn("unk_ok", F.col("unk_rate") < 0.1).withColumn("fertility_ok", F.coalesce((F.col("fertility") > 2.0) & (F.col("fertility") < 3.0), F.lit(False)))
    return out.withColumn("verdict", F.col("eos_ok") & F.col("unk_ok") & F.col("fertility_ok"))


def begins_at(pieces: Column, place: Column) -> Column:
    """Whether a piece begins at a place of the marked word that the pieces make up."""
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return F.array_contains(ends, place)
