"""Line and suggestion functions on literal pairs, one for each branch."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import corpus, metrics, tokens, unigram

CASES = {
    text.quick_clean: [
        ("see https://x.y/z now ok", "see now ok"), ("mail a@b.cd here please", "mail here please"), ("hi @you there friend", "hi there friend"),
        ("tag #Proposamena and #ab end", "tag Proposamena and end"), ("wow!!!! ok??? a,, b;; c---- d..... e", "wow!! ok?? a, b; c-- d... e"),
        ("one", ""), ("", ""), ("\U0001F600\U0001F600\U0001F600 a", ""), ("great \u2764\u2764\u2764\u2764 day for us all here", "great \u2764\u2764 day for us all here"),
    ],
    text.strip_decrees: [("7/1990 legea, uztailaren 3koa", "uztailaren 3koa"), ("abenduaren 23ko 11/2015 Legearen testuan", "abenduaren 23ko Legearen testuan"), ("255/2012 autoak.", "")],
    text.filter_suggestion: [
        ("da??) eta", "da? eta"), ("kaixo . ,", "kaixo"), ("\u2581zer moduz", " zer moduz"), ("\nparagraph", ""), (" .", ""), (".", "."), ("123", ""), ("LLC.,", "LLC."), ("a  b ", "a b"), ("", ""),
    ],
    lambda x: text.phase3(x)[1]: [
        ("943 22 46 43", "digit_pure"), ("2016/04/07", "digit_pure"), ("call 12345678 now friend", "digit_long_run"), ("a1 b2 c3 word more", "digit_heavy_tokens"),
        ("lower case fragment", "orphan_fragment"), ("A whole sentence stays.", None), ("lower but ended.", None),
    ],
    lambda x: text.strip_mentions(x): [("\u00e9@x", "\u00e9@x"), (" @x", " ")],
}


@pytest.mark.parametrize("function", list(CASES), ids=["quick_clean", "strip_decrees", "filter_suggestion", "phase3", "mentions"])
def test_pairs(spark, function):
    pairs = CASES[function]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string").select("i", function(F.col("x")).alias("y"))
    got = {r.i: r.y for r in df.collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]


def test_ghost_suffix(spark):
    rows = [("Kaixo, zer mod", "Kaixo, zer", " moduz?", "uz?"), ("Kaixo?", "Kaixo?", "? zer", " zer"), ("Euskal He", "Euskal", " Herria", "rria"), ("abc", "abc", " x", " x"), ("ab XY", "ab", "qq", "qq"), ("a", "a", "", "")]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, c string, s string").select(text.ghost_suffix(F.col("t"), F.col("c"), F.col("s")).alias("g"))
    assert [r.g for r in df.collect()] == [r[3] for r in rows]


def test_best_of_and_judgments(spark):
    c = spark.createDataFrame([(1, 0, "", 0.9, "stop"), (1, 1, "a", 0.5, "length"), (1, 2, "b", 0.5, "stop"), (2, 0, "", 0.3, "stop")], "k int, idx int, text string, confidence double, finish string")
    assert sorted(map(tuple, metrics.best_of(c, "k").collect())) == [(1, "a", 0.5, "length"), (2, "", 0.0, "stop")]
    j = spark.createDataFrame([("1: A, 2=B 3 T; 1. B",)], "x string").select(metrics.parse_judgments(F.col("x")).alias("m")).first()["m"]
    assert j == {"1": "B", "2": "B", "3": "T"}


def test_tokens(spark):
    df = spark.createDataFrame([("ab abc zz",)], "line string")
    vocabulary = unigram.Vocabulary([("<unk>", 0.0), ("\u2581ab", -1.0), ("c", -2.0), ("\u2581", -3.0), ("a", -4.0)])
    assert unigram.encoded(df, vocabulary).first()["ids"] == [1, 1, 2, 3, 0]
    a = spark.range(1).select(tokens.find_array(F.array(*map(F.lit, (1, 2, 3, 4))), F.array(F.lit(3), F.lit(4))).alias("i"), tokens.find_array(F.array(F.lit(1)), F.array(F.lit(3), F.lit(4))).alias("j")).first()
    assert tuple(a) == (2, -1)
    lines = spark.createDataFrame([(1, 0, " ".join("w" * 99)), (1, 1, "a b c"), (1, 2, " ".join("w" * 300))], "doc_id int, line_no int, line string")
    assert tokens.packed(lines.withColumn("line", F.regexp_replace("line", "w", "w")), 128).first()["truncated"] == 1


def test_phase2_exact_conserves_lines(spark):
    docs = spark.createDataFrame([(1, "Hello there.\nHello there.\nSome words here ok. Then more words ok. And the last one is ok.\n\nx"), (2, None)], "doc_id long, text string")
    got = corpus.phase2_exact(docs).filter("doc_id = 1").orderBy("line_no", "sub_no").collect()
    assert [r.tag for r in got if r.line_no == 1] == ["repeated"]
    assert [r.cleaned for r in got if r.line_no == 2 and r.tag is None] == ["Some words here ok.", "Then more words ok.", "And the last one is ok."]


def test_character_references_of_the_whole_table(spark):
    import html
    import html.entities
    import random

    rnd = random.Random(2)
    names = sorted(html.entities.html5)
    texts = [f"a &{n} b&{n.rstrip(';')}x" for n in names] + [f"&#{n};&#x{n:x} &#X{n:04X};" for n in [*range(300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF, 0x110000, 99999999, 10**12]]
    texts += ["&", "&;", "&#;", "&#x;", "&#xg", "&&amp;&amp", "&notit;", "&notin;", "&amp;lt;", "&#0000000000065;", "plain", "", None, "&thisisnoname;", "& amp;", "AT&T &copyright &COPY"]
    texts += ["".join(rnd.choice(["&", ";", "#", "x", "1", "not", "in", "lt", "amp", " ", "é", "&#65", "😀"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = df.select(text.unescaped(F.col("t")).alias("u"), "t")
    assert not [(r.t, r.u, html.unescape(r.t)) for r in plan.collect() if r.t is not None and r.u != html.unescape(r.t)]
    assert "Python" not in plan._jdf.queryExecution().toString()
