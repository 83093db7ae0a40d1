"""Awkward rows in the operators that the brute-force tests don't feed them to."""

from pyspark.sql import functions as F

from tallgrass.llm import html_blocks, knn, mixing, warc

PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><div class="ad">Buy this and that.</div>'
    "<article><h1>The title</h1><p><b>It was the best of times and the worst of times, as it is said in that book &amp; in others.<br>More of it<p>Short.</article>"
    '<div id="comments"><p>I think that this is the best of all the pages that I have seen in my life.</p></div><footer>&copy; us</footer></body></html>'
)


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>a < b" * 3000, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_blocks.extracted(df).collect()
    assert len(got) == 5 and html_blocks.extracted(df.limit(0)).count() == 0
    texts = [r.text for r in got if r.page_id == 1]
    assert texts == ["The title\n\nIt was the best of times and the worst of times, as it is said in that book & in others. More of it\n\nShort."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))


def test_warc(spark):
    big = "z" * 200
    rows = [(5, "http://a/ü x", big, "k"), (3, None, big, "k"), (3, None, big, "k"), (9, "u", "tiny", "k"), (8, "u", "tiny", "k"), (7, "u", None, "k"), (None, "u", big, "k"), (2, "u", "q" * 300_000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, file_bytes=200), payload=True).collect()}
    assert got == {(5, 200, "revisit", 3), (3, 200, "response", None), (9, 4, "response", None), (8, 4, "response", None), (7, 0, "response", None), (None, 200, "revisit", 3), (2, 300_000, "response", None)}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_knn_and_mixing(spark, odd, nothing, documents, labels):
    none = labels.limit(0)
    assert {r.score for r in knn.scored(odd, none).collect()} == {0.5}
    assert knn.scored(nothing, labels).count() == 0
    got = knn.scored(documents, labels.filter(~knn.held_out(F.col("doc_id")))).join(labels.filter(knn.held_out(F.col("doc_id"))), "doc_id")
    assert got.filter("predicted = quality").count() >= 0.8 * got.count() > 0
    ones = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rated, domains = mixing.mixed(odd, ones, domain="key")
    assert rated.count() == odd.count() and domains == ["y"] and rated.filter("_rate < 0 OR _rate IS NULL").count() == 0
    assert mixing.mixed(odd, none)[0].count() == odd.count() if "lang" in odd.columns else True
    assert mixing.mixed(nothing, ones, domain="key")[0].count() == 0
    kept = mixing.taken(documents, labels)
    assert kept.columns == documents.columns and kept.select("doc_id").distinct().count() == documents.count()
