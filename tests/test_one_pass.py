"""Work that is to be done once a row."""

from tallgrass.operators import corpus, tokens


def test_special_ids_are_counted_in_one_pass(spark):
    rows = [([4000, 7, 2],), ([9, 70000],), ([4000, None, 4000],), ([],), (None,)]
    df = spark.createDataFrame(rows, "ids array<long>")
    got = tokens.special_histogram(df)
    assert sorted(map(tuple, got.collect())) == [(2, 1, False), (4000, 3, False), (70000, 1, False)]
    assert sorted(map(tuple, tokens.special_histogram(df.limit(1)).collect())) == [(2, 1, True), (4000, 1, True)]
    assert tokens.special_histogram(df.limit(0)).count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_lines_are_cleaned_in_one_pass(spark):
    joined = "First one ends here. Then another comes. At last a third follows."
    docs = spark.createDataFrame([(1, f"{joined}\nThen another comes.\nalone\n{joined}"), (2, "Then another comes."), (3, ""), (4, None), (None, "No id but text.")], "doc_id long, text string")
    found = corpus.phase2_exact(docs)
    got = {(r.doc_id, r.line_no, r.sub_no): (r.cleaned, r.tag) for r in found.collect()}
    assert got == {
        (1, 0, 0): ("First one ends here.", None), (1, 0, 1): ("Then another comes.", None), (1, 0, 2): ("At last a third follows.", None),
        (1, 1, -1): ("Then another comes.", "repeated"), (1, 2, -1): ("alone", "digit_decree_stripped"), (1, 3, -1): (joined, "repeated"),
        (2, 0, -1): ("Then another comes.", None), (3, 0, -1): ("", "discard"), (None, 0, -1): ("No id but text.", None),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
