"""Token streams: pieces, fill-in-the-middle examples, flat chunks and packed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators.stream import placed

# Ids of the special tokens.
UNK, EOS, PREFIX, SUFFIX, MIDDLE, EOT = 0, 2, 4000, 4001, 4002, 4003


def pieces(word: Column, size: int = 3) -> Column:
    """A stand-in subword model that SQL can follow: runs of ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(word) / size).cast("int") - 1)), lambda i: F.substring(word, i * size + 1, F.lit(size)))


def hashed_ids(pieces_: Column, size: int = 3990, first: int = 5) -> Column:
    """Ids that depend on a piece alone, above those of the special tokens."""
    return F.transform(pieces_, lambda p: F.conv(F.substring(F.md5(p), 1, 6), 16, 10).cast("long") % size + first)


def counted(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "line_no", (F.size(text.words(F.col("line"))) + 1).alias("n"))


def flat_chunks(lines: DataFrame, window: int) -> DataFrame:
    """Windows of a document's token stream (a line's words and an end mark); the rest is dropped."""
    t = counted(lines).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))
    t = t.withColumn("windows", F.expr(f"(n_tokens - 1) div {window}"))
    return t.withColumn("dropped", F.expr(f"n_tokens - 1 - {window} * windows"))


def packed(lines: DataFrame, window: int) -> DataFrame:
    """Greedy packing of a document's examples, in order, into windows of ``window + 1`` tokens:
    one that doesn't fit opens the next, a longer one is cut and stands alone."""
    room = window + 1
    lens = counted(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "n"))), lambda x: x["n"]).alias("lens"))
    start = F.struct(F.lit(0).alias("windows"), F.lit(0).alias("used"), F.lit(0).alias("packed"), F.lit(0).alias("truncated"))

    def step(a, n):
        long, opens = n > room, (a["windows"] == 0) | (a["used"] + n > room)
        size = F.least(n, F.lit(room))
        return F.struct(
            (a["windows"] + opens.cast("int")).alias("windows"), F.when(opens, size).otherwise(a["used"] + n).alias("used"),
            (a["packed"] + size).alias("packed"), (a["truncated"] + long.cast("int")).alias("truncated"),
        )

    x = lens.withColumn("r", F.aggregate("lens", start, step))
    return x.select("doc_id", F.size("lens").alias("examples"), "r.windows", "r.truncated", F.round(100.0 * (1 - F.col("r.packed") / (F.col("r.windows") * room)), 4).alias("padding_pct"))


def fim(lines: DataFrame, least: int = 10, min_middle: int = 2) -> DataFrame:
    """Fill-in-the-middle splits of half of the lines of ``least`` words, drawn by hashes of the
    line's place, so that a retried task draws the same."""
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))), 1, 7), 16, 10).cast("long")
    x = lines.withColumn("c", draw("c")).filter("c % 2 = 0")  # first: the draw costs less than the words
    x = x.select("doc_id", "line_no", "c", text.words(F.col("line")).alias("w")).withColumn("n", F.size("w")).filter(F.col("n") >= least)
    x = x.withColumn("p1", (draw("a") % F.greatest(F.lit(1), F.col("n") - min_middle + 1)).cast("int"))
    x = x.withColumn("p2", (F.col("p1") + min_middle + draw("b") % F.greatest(F.lit(1), F.col("n") - F.col("p1") - min_middle + 1)).cast("int"))
    cut = lambda a, b: F.slice("w", a + 1, F.greatest(F.lit(0), b - a))
    zero = F.lit(0)
    return x.select(
        "doc_id", "line_no", "w", cut(zero, F.col("p1")).alias("prefix"), cut(F.col("p1"), F.col("p2")).alias("middle"), cut(F.col("p2"), F.col("n")).alias("suffix"),
        F.when(F.expr("(c div 2) % 2 = 0"), "psm").otherwise("spm").alias("mode"),
    )


def assembled(prefix: Column, middle: Column, suffix: Column, mode: Column) -> Column:
    """Token ids of an example in prefix- or suffix-first order, ended by EOT and EOS."""
    mark = lambda i: F.array(F.lit(i))
    tail = F.concat(mark(MIDDLE), middle, mark(EOT), mark(EOS))
    return F.when(mode == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, tail)).otherwise(F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, tail))


def find_array(haystack: Column, needle: Column) -> Column:
    """0-based place of the first occurrence of an array in another, or -1."""
    last = F.size(haystack) - F.size(needle)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle)
    return F.when(last < 0, -1).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(-1)))


def with_end(lines: DataFrame, ids: Column) -> DataFrame:
    """Lines with their ``ids`` and the end id."""
    return lines.withColumn("ids", F.concat(ids, F.array(F.lit(EOS).cast("long"))))


def streams(lines: DataFrame) -> DataFrame:
    """``doc_id, s``: a document's ids in the order of its lines, so that one document bounds an array."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "ids")))
    return lines.groupBy("doc_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).alias("s"))


def boundaries(streams_: DataFrame) -> DataFrame:
    """Examples end at each end id; the longest one and the ids after the last are counted."""
    ends = F.filter(F.transform("s", lambda x, i: F.when(x == EOS, i + 1)), lambda i: i.isNotNull())
    x = streams_.withColumn("e", ends)
    sizes = F.transform("e", lambda v, k: v - F.coalesce(F.get("e", k - 1), F.lit(0)))
    return x.select("doc_id", F.size("e").cast("long").alias("examples"), F.array_max(sizes).cast("long").alias("longest"), (F.size("s") - F.coalesce(F.try_element_at("e", F.lit(-1)), F.lit(0))).cast("long").alias("trailing"))


def padded_windows(streams_: DataFrame, window: int, pad: int = 0) -> DataFrame:
    """``x`` and ``y`` of each window of a stream, the last filled up: also what streams without ends are cut into."""
    count = F.floor((F.size("s") + window - 1) / window).cast("int")
    w = streams_.filter("size(s) > 0").select("doc_id", "s", F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    part = F.slice("s", F.col("window_no") * window + 1, F.lit(window + 1))
    w = w.select("doc_id", F.col("window_no").cast("long").alias("window_no"), part.alias("p")).withColumn("padding", window + 1 - F.size("p"))
    full = F.concat("p", F.array_repeat(F.lit(pad).cast("long"), F.col("padding")))
    return w.select("doc_id", "window_no", F.slice(full, 1, window).alias("x"), F.slice(full, 2, window).alias("y"), "padding")


def ppl_windows(streams_: DataFrame, window: int) -> DataFrame:
    n = F.size("s") - 1
    whole, rest = F.floor(n / window), n % window
    return streams_.select("doc_id", F.size("s").cast("long").alias("tokens"), whole.alias("whole"), rest.cast("long").alias("rest"), (whole + F.when(rest > 0, 1).otherwise(0)).cast("long").alias("windows"))


def strided(streams_: DataFrame, window: int, count: int) -> DataFrame:
    n = F.floor((F.size("s") - 1) / window).cast("int")
    x = streams_.withColumn("n", n).filter("n > 0").select("doc_id", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    x = x.withColumn("start", F.col("i") * 7 % F.col("n") * window)
    return x.select("doc_id", F.col("i").cast("long").alias("i"), F.col("start").cast("long").alias("start"), F.get("s", F.col("start")).alias("first_id"))


def special_histogram(examples: DataFrame, first: int = PREFIX, most: int = 65535) -> DataFrame:
    """Counts of the special ids, and whether all ids are at most ``most``."""
    special = lambda i: (i < 5) | (i >= first)
    both = text.let(F.col("ids"), lambda v: F.struct(F.filter(v, special).alias("special"), F.array_max(v).alias("top")))
    each = examples.select(both.alias("b")).select(F.explode_outer("b.special").alias("id"), "b.top")  # examples without one still count for the largest id
    found = each.groupBy("id").agg(F.count("*").alias("n"), F.max("top").alias("top"))  # a row a special id
    return found.withColumn("fits", F.max("top").over(Window.partitionBy()) <= most).filter("id IS NOT NULL").select("id", "n", "fits")


def marked_pieces(words: Column, size: int = 3) -> Column:
    """The stand-in pieces of words, each word's first marked by ``▁``."""
    return F.flatten(F.transform(words, lambda w: F.transform(pieces(w, size), lambda p, i: F.when(i == 0, F.concat(F.lit("▁"), p)).otherwise(p))))


def boundaries_of(pieces_: Column) -> Column:
    """0, every place whose piece begins a word, and the end, once each."""
    starts = F.filter(F.transform(pieces_, lambda p, i: F.when(p.startswith("▁") | (i == 0), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.concat(starts, F.array(F.size(pieces_))))


def piece_splits(lines: DataFrame, share: int = 20, min_middle: int = 2) -> DataFrame:
    """``p1, p2`` of the prefix, middle and suffix of ``pieces``: drawn by hashes of the line's place; for
    ``share`` of a hundred lines both are word boundaries, if two are far enough apart."""
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))), 1, 7), 16, 10).cast("long")
    n = F.size("pieces")
    x = lines.withColumn("_b", boundaries_of(F.col("pieces"))).filter(n >= min_middle + 2)
    x = x.withColumn("_q1", (draw("a") % F.greatest(F.lit(1), n - min_middle + 1)).cast("int")).withColumn("_q2", (F.col("_q1") + min_middle + draw("b") % F.greatest(F.lit(1), n - F.col("_q1") - min_middle + 1)).cast("int"))
    x = x.withColumn("_p1", F.get("_b", (draw("d") % F.greatest(F.lit(1), F.size("_b"))).cast("int"))).withColumn("_far", F.filter("_b", lambda i: i >= F.col("_p1") + min_middle))
    x = x.withColumn("on_boundary", (draw("e") % 100 < share) & (F.size("_far") > 0))
    p2 = F.get("_far", (draw("f") % F.greatest(F.lit(1), F.size("_far"))).cast("int"))
    return x.withColumn("p1", F.when(F.col("on_boundary"), F.col("_p1")).otherwise(F.col("_q1"))).withColumn("p2", F.when(F.col("on_boundary"), p2).otherwise(F.col("_q2"))).drop("_b", "_q1", "_q2", "_p1", "_far")


def numbered(vocabulary: DataFrame, piece: str) -> DataFrame:
    """``id, piece`` from 0 in the order of spelling."""
    return placed(vocabulary.select(F.col(piece).alias("piece")), ["piece"]).select(F.col("number").alias("id"), "piece")


def appended(vocabulary: DataFrame, new: list[str]) -> DataFrame:
    """The vocabulary and new pieces after its last id."""
    rows = F.explode(F.array(*[F.struct(F.lit(k + 1).cast("long").alias("k"), F.lit(p).alias("piece")) for k, p in enumerate(new)])).alias("x")
    more = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last")).select("last", rows)
    return vocabulary.unionByName(more.select((F.col("last") + F.col("x.k")).alias("id"), "x.piece"))


def append_check(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sizes, and how many old pieces have another id now."""
    a, b = old.select("piece", F.col("id").alias("before")), new.select("piece", F.col("id").alias("after"))
    x = a.join(b, "piece", "full")
    return x.agg(F.count("before").alias("old_size"), F.count("after").alias("new_size"), F.count_if(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("after"))).cast("int").alias("moved"))
