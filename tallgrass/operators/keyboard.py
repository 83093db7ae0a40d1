"""The predictive keyboard: candidates by prefix, sticky merging, typing simulations and their replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import suggestion
from tallgrass.functions.text import words

BOOST, POOL, SHOWN, FETCHED = 0.1, 5, 3, 5
TRACE = "array<struct<type string, prefix string, char string, accepted string, method string, prob double, sticky boolean, prefix_len int, displayed array<struct<text string, prob double>>, fresh array<struct<text string, prob double>>>>"
RESULT = (
    "csr double, acceptance_rate double, top1 double, top3 double, top5 double, avg_prefix double, avg_confidence double, keystrokes int, taps int, n_words int, total_chars int, "
    f"completed array<struct<word string, method string, prob double>>, events {TRACE}"
)


def ranked(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """``k`` candidates of each key, likeliest first, ties by spelling: a word that several paths give
    keeps its highest probability, and next words are words of their own."""
    best = rows.groupBy(*key, "is_next", "text").agg(F.max("prob").alias("prob"))
    w = Window.partitionBy(*key).orderBy(F.desc("prob"), "is_next", "text")
    return best.filter(~suggestion.has_garbage(F.col("text"))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyboard_candidates(contexts: DataFrame, followers: DataFrame, k: int = FETCHED) -> DataFrame:
    """``id, prev, typed, rank, text, prob, is_next`` for ``contexts(id, prev, typed)`` from
    ``followers(prev, word, prob)``: words after ``prev`` that begin as typed, and, where a whole word is
    typed, the words after it. Each distinct context is ranked once, however many rows ask for it;
    only beginnings that are asked for are ranked, and of the words after a word only the first ``k``."""
    wanted = contexts.select("prev", "typed").distinct()
    plain = followers.filter(~suggestion.has_digit(F.col("word")))
    # each beginning of a follower is a row, so that both columns are keys of the join
    begun = plain.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.left("word", n))).alias("typed")).join(wanted, ["prev", "typed"], "left_semi")
    inside = begun.select("prev", "typed", F.col("word").alias("text"), "prob", F.lit(False).alias("is_next"))
    asked = wanted.filter("typed <> ''")
    after = plain.join(asked.select(F.col("typed").alias("prev")).distinct(), "prev", "left_semi").select(F.col("prev").alias("typed"), F.col("word").alias("text"), "prob", F.lit(True).alias("is_next"))
    after = asked.join(ranked(after, ["typed"], k), "typed").select("prev", "typed", "text", "prob", "is_next")
    best = ranked(inside.unionByName(after), ["prev", "typed"], k)
    return contexts.join(best, ["prev", "typed"])


def merged(pool: DataFrame, fresh: DataFrame, key: list[str], typed: Column, boost: float = BOOST, keep: int = POOL) -> DataFrame:
    """Sticky merge of ``(*key, at, text, prob)``: candidates of the pool that still begin as typed, boosted,
    and fresh ones that are not among them; ties keep their order, pool first."""
    alive = pool.filter((typed != "") & F.lower("text").startswith(F.lower(typed))).withColumn("sticky", F.lit(True))
    new = fresh.join(alive.select(*key, "text"), [*key, "text"], "left_anti").withColumn("sticky", F.lit(False))
    both = alive.unionByName(new)
    score = F.col("prob") + F.when(F.col("sticky"), boost).otherwise(0.0)
    w = Window.partitionBy(*key).orderBy(F.desc(score), F.desc("sticky"), "at")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


# --- the typing simulation, one test at a time -------------------------------------------------------


def bare(word: str) -> str:
    return word.lower().strip(suggestion.MARKS)


class Typist:
    """Types words on a keyboard that offers chips, and keeps a trace.

    ``offers(prev, typed)`` gives the fresh candidates ``(text, prob, is_next)`` for the word before the
    current one and what is typed of it. At each check the pool is merged with them; the first
    of the shown chips that is the wanted word is tapped, else the next character is typed.
    """

    def __init__(self, offers: Callable[[str, str], list[tuple[str, float, bool]]], prompt: str):
        self.offers, self.text, self.pool = offers, prompt, []
        self.events: list[dict] = []
        self.completed: list[tuple[str, str, float]] = []
        self.keys = self.taps = 0
        self.hits = {1: 0, 3: 0, 5: 0}

    def check(self) -> tuple[list[tuple], list[tuple]]:
        head, _, typed = self.text.rpartition(" ")
        before = head.split()
        fresh = self.offers(before[-1].lower() if before else "", typed.lower())
        alive = [(*c[:3], True) for c in self.pool if typed and c[0].lower().startswith(typed.lower())]
        new = [(*c, False) for c in fresh if c[0] not in {a[0] for a in alive}]
        order = sorted(alive + new, key=lambda c: -(c[1] + BOOST * c[3]))
        self.pool = order[:POOL]
        self.log("check", prefix=self.text[-60:], displayed=[{"text": c[0], "prob": c[1]} for c in order[:SHOWN]], fresh=[{"text": c[0], "prob": c[1]} for c in fresh])
        return order[:SHOWN], fresh

    def log(self, kind: str, **fields) -> None:
        names = ("prefix", "char", "accepted", "method", "prob", "sticky", "prefix_len", "displayed", "fresh")
        self.events.append({"type": kind} | {n: fields.get(n) for n in names})

    def tap(self, chip: tuple) -> None:
        text, prob, is_next, sticky = chip
        head, space, typed = self.text.rpartition(" ")
        method = "next_word" if is_next else "completion"
        self.log("accept", accepted=text, method=method, prob=prob, sticky=sticky, prefix_len=len(typed))
        if is_next:
            self.text += f" {text} "
        elif text and not set(text) - set(suggestion.PUNCTUATION):
            self.text = self.text.removesuffix(" ") + text + " "
        else:
            self.text = f"{head}{space}{text} "
        self.pool, self.taps, self.keys = [], self.taps + 1, self.keys + 1
        self.completed.append((text, method, prob))

    def type(self, char: str) -> None:
        self.text, self.keys = self.text + char, self.keys + 1
        self.log("keystroke", char=char)

    def word(self, target: str) -> None:
        wanted, seen = bare(target), {1: False, 3: False, 5: False}
        rest = iter(target)
        started = False
        while True:
            shown, fresh = self.check()
            right = [c for c in shown if wanted and bare(c[0]) == wanted]
            seen[1] |= bool(shown) and bool(wanted) and bare(shown[0][0]) == wanted
            seen[3] |= bool(right)
            seen[5] |= any(wanted and bare(c[0]) == wanted for c in fresh[:5])
            if right:
                self.tap(right[0])
                break
            char = next(rest, None)
            if char is None:
                self.completed.append((target, "manual", 0.0))
                break
            if not started and self.text and not self.text[-1].isspace():
                self.type(" ")
            started = True
            self.type(char)
        for k, hit in seen.items():
            self.hits[k] += hit

    def result(self, target: str) -> dict:
        n, chars = len(self.completed), len(target)
        sure = [p for _, _, p in self.completed if p > 0]
        lens = [e["prefix_len"] for e in self.events if e["type"] == "accept"]
        part = lambda x, whole, digits: round(x / whole, digits) if whole else 0.0
        return {
            "csr": part(chars - self.keys, chars, 4), "acceptance_rate": part(self.taps, n, 4), "top1": part(self.hits[1], n, 4), "top3": part(self.hits[3], n, 4), "top5": part(self.hits[5], n, 4),
            "avg_prefix": part(sum(lens), len(lens), 2), "avg_confidence": part(sum(sure), len(sure), 4), "keystrokes": self.keys, "taps": self.taps, "n_words": n, "total_chars": chars,
            "completed": self.completed, "events": self.events,
        }


def simulate(tests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Typing of ``tests(test_id, prompt, target)`` with ``candidates(id, prev, typed, rank, text, prob, is_next)``
    of each test: its metrics and trace. A test is one row, so that its state is one task's."""
    offered = F.struct("prev", "typed", "rank", "text", "prob", "is_next")
    known = candidates.groupBy(F.col("id").alias("test_id")).agg(F.array_sort(F.collect_list(offered)).alias("offered"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for test_id, prompt, target, found in zip(pdf.test_id, pdf.prompt, pdf.target, pdf.offered, strict=True):
                table: dict[tuple[str, str], list] = {}
                for c in [] if found is None else found:
                    table.setdefault((c["prev"], c["typed"]), []).append((c["text"], c["prob"], c["is_next"]))
                typist = Typist(lambda prev, typed, t=table: t.get((prev, typed), []), prompt or "")
                for w in (target or "").split():
                    typist.word(w)
                out.append({"test_id": test_id, **typist.result(target or "")})
            names = ["test_id", *(x.split()[0] for x in RESULT.split(", ")[:11]), "completed", "events"]
            yield pd.DataFrame([[r[n] for n in names] for r in out], columns=names)

    x = tests.join(known, "test_id", "left").select("test_id", "prompt", "target", "offered")
    kind = tests.schema["test_id"].dataType.simpleString()
    return x.mapInPandas(run, f"test_id {kind}, {RESULT}")


def contexts_of(tests: DataFrame) -> DataFrame:
    """``id, prev, typed``: what a test's typing can ask for: each prefix of each word after the one before, and the word before itself."""
    x = tests.select(F.col("test_id").alias("id"), words(F.lower(F.concat_ws(" ", "prompt", "target"))).alias("w"))
    spots = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.when(i > 0, F.get("w", i - 1)).otherwise("").alias("prev"), F.get("w", i).alias("word")))
    x = x.filter("size(w) > 0").select("id", F.inline(spots))
    typed = F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.left("word", n))
    return x.select("id", "prev", F.explode(typed).alias("typed")).distinct()


def _done_by(method: str) -> Callable[[Column], Column]:
    return lambda c: c["method"] == method


def summary(results: DataFrame, by: str) -> DataFrame:
    """Micro saving, word-weighted accuracies (of the rounded ones), acceptance, prefix and confidence by group and overall."""
    share = lambda k: F.round(F.sum(F.col(k) * F.col("n_words")) / F.sum("n_words"), 4).alias(k)
    flat = results.withColumns({
        "_prob": F.aggregate(F.filter("completed", lambda c: c["prob"] > 0), F.lit(0.0), lambda a, c: a + c["prob"]), "_sure": F.size(F.filter("completed", lambda c: c["prob"] > 0)),
        "_most": F.array_max(F.transform(F.filter("completed", lambda c: c["prob"] > 0), lambda c: c["prob"])),
        "_len": F.aggregate(F.filter("events", lambda e: e["type"] == "accept"), F.lit(0), lambda a, e: a + e["prefix_len"]),
        **{f"_{m}": F.size(F.filter("completed", _done_by(m))) for m in ("completion", "next_word", "manual")},
    })
    safe = lambda a, b, digits: F.coalesce(F.round(F.try_divide(F.sum(a), F.sum(b)), digits), F.lit(0.0))
    x = flat.rollup(by).agg(
        F.count("*").alias("tests"), F.round((F.sum("total_chars") - F.sum("keystrokes")) / F.sum("total_chars"), 4).alias("csr"), F.round(F.avg("csr"), 4).alias("macro_csr"),
        share("top1"), share("top3"), share("top5"), F.round(F.sum("taps") / F.sum("n_words"), 4).alias("acceptance"), safe("_len", "taps", 2).alias("avg_prefix"), safe("_prob", "_sure", 4).alias("avg_confidence"), F.coalesce(F.round(F.max("_most"), 4), F.lit(0.0)).alias("max_prob"),
        *[F.sum(f"_{m}").alias(m) for m in ("completion", "next_word", "manual")],
    )
    return x.withColumn(by, F.coalesce(by, F.lit("all")))


def replayed(results: DataFrame) -> DataFrame:
    """Top-1/3/5 counts recomputed from stored traces ``test_id, words, events``, and the words' ways of completion.

    A word ends where its chip was taken, or at a check that doesn't show it once all of its
    characters were typed; that check then counts for the next word too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([[i, *_replay(list(w), list(e))] for i, w, e in zip(pdf.test_id, pdf.words, pdf.events, strict=True)], columns=["test_id", "top1", "top3", "top5", "n_words", "methods"])

    kind = results.schema["test_id"].dataType.simpleString()
    return results.select("test_id", "words", "events").mapInPandas(run, f"test_id {kind}, top1 int, top3 int, top5 int, n_words int, methods array<string>")


def _replay(targets: list[str], events: list[dict]) -> tuple[int, int, int, int, list[str]]:
    flags: list[list[bool]] = [[False] * 3 for _ in targets]
    methods: list[str] = []
    typed = 0
    for e in events:
        if e["type"] == "keystroke":
            typed += e["char"] != " "
        elif e["type"] == "accept":
            methods.append("completion")
            typed = 0
        else:
            shown, fresh = ([bare(c["text"]) for c in e[k]] if e[k] is not None else [] for k in ("displayed", "fresh"))
            while len(methods) < len(targets) and (wanted := bare(targets[len(methods)])):
                now = flags[len(methods)]
                now[:] = [now[0] or shown[:1] == [wanted], now[1] or wanted in shown[:3], now[2] or wanted in fresh[:5]]
                if wanted in shown[:3] or typed < len(targets[len(methods)]):
                    break
                methods.append("manual")
                typed = 0
    done = flags[: len(methods)]
    return *(sum(f[k] for f in done) for k in range(3)), len(targets), methods
