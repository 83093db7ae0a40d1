"""Sources and sinks: what is written is read again, and what readers promise of awkward input."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.sources import corpus as src
from tallgrass.sources import reports


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("a", 0, 0, "one two"), ("a", 0, 1, ""), ("b", 1, 0, "három x"), ("b1", 2, 0, "z")], "source string, doc_id long, line_no int, line string")


def test_text_folders(spark, lines, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"one\nt\xffwo\n\nlast")
    (tmp_path / "in/b.md").write_text("no")
    got = {tuple(r) for r in src.read_text(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.txt", "one"), ("a.txt", "t�wo"), ("a.txt", ""), ("a.txt", "last")}
    assert src.read_text(spark, str(tmp_path / "in/a.txt")).count() == 4
    src.write_text(lines, str(tmp_path / "kept"))
    src.write_text(lines, str(tmp_path / "dropped"), keep_blank=False)
    read = lambda p: sorted(r.value for r in spark.read.text(str(tmp_path / p)).collect())
    assert read("kept") == ["", "három x", "one two", "z"] and read("dropped") == ["három x", "one two", "z"]


def test_concatenation_reports_what_is_kept(spark, tmp_path):
    for name, text in (("wiki", "a\nb"), ("news", "cc"), ("news2", "d")):
        (tmp_path / f"{name}.txt").write_text(text)
    out, report = src.concatenated(spark, str(tmp_path), ["news"])
    assert sorted(r.line for r in out.collect()) == ["a", "b"]
    assert {(r.source, r.kept, r.bytes) for r in report.collect()} == {("wiki.txt", True, 3), ("news.txt", False, 2), ("news2.txt", False, 1)}


def test_token_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [5, 6, 2]), (1, 1, [7, 2]), (2, 0, [65535])], "doc_id long, line_no int, ids array<long>")
    path = str(tmp_path / "tokens")
    src.write_tokens(rows, path)
    got = {r.doc_id: r.ids for r in src.read_tokens(spark, path).collect()}
    assert got == {1: [5, 6, 2, 7, 2], 2: [65535]}
    r = src.checked_tokens(spark, path).first()
    assert (r.tokens, r.max_id, r.distinct_ids) == (6, 65535, 5)
    src.write_tokens(rows.withColumn("ids", F.array(F.lit(70_000).cast("long"))), str(tmp_path / "wide"))
    with pytest.raises(Exception, match="two bytes"):
        src.checked_tokens(spark, str(tmp_path / "wide")).collect()
    windows = sorted((r.doc_id, r.k, r.x, r.y) for r in src.token_windows(src.read_tokens(spark, path), 2).collect())
    assert windows == [(1, 0, [5, 6], [6, 2]), (1, 1, [2, 7], [7, 2])]


def test_targets(spark, tmp_path):
    tests = [{"category": "c", "input": "say", "target_completion": "this"}, {"input": "or", "target_completion": "that"}]
    shape = {"strategies": [{"name": "csr", "tests": tests}, {"name": "morphacc", "tests": [{"input": "x", "valid_suffixes": ["a"]}]}, {"name": "csr", "tests": [{"input": "later"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(shape, indent=1))
    path = str(tmp_path / "t.json")
    assert [(r.category, r.input) for r in src.read_targets(spark, path, "csr").collect()] == [("c", "say"), ("unknown", "or")]
    assert src.read_targets(spark, path, "morphacc").first().valid_suffixes == ["a"]
    both = src.read_target_sets(spark, path, ["csr", "morphacc"])
    assert sorted((r.strategy, r.input) for r in both.collect()) == [("csr", "or"), ("csr", "say"), ("morphacc", "x")]
    pairs = src.target_pairs(spark, path)
    assert sorted(tuple(r) for r in pairs.collect()) == [("c", "say", "this", "say this"), ("targets_json", "or", "that", "or that")]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    src.append_log(spark.createDataFrame([("2024-01-01 00:00:00", "m", "accept")], "timestamp string, model string, event string"), path)
    src.append_log(spark.createDataFrame([("2024-01-02 00:00:00", "m", "show")], "timestamp string, model string, event string"), path)
    (tmp_path / "log/more.json").write_text('{"timestamp": "2024-01-03", "event": "x"\n{"timestamp": "2024-01-04", "event": "last"}\n')
    schema = "timestamp STRING, model STRING, event STRING"
    assert [r.event for r in src.tail_log(spark, path, schema, 2).collect()] == ["last", "show"]
    assert tuple(src.log_totals(spark, path, schema).first()) == (4, 1)


def test_vocabulary_wiki_schema_and_files(spark, tmp_path):
    v = spark.createDataFrame([("▁a", -1.5, 0), ('"', -2.0, 1)], "piece string, score double, id long")
    src.write_vocabulary(v, str(tmp_path / "vocab"))
    assert sorted((r.piece, r.score) for r in src.read_vocabulary(spark, str(tmp_path / "vocab")).collect()) == [('"', -2.0), ("▁a", -1.5)]
    page = {"query": {"pages": {"1": {"title": "T", "extract": "e" * 300}, "2": {"title": "U", "extract": "short"}, "3": {"title": "V"}}}}
    got = src.wiki_extracts(spark.createDataFrame([(json.dumps(page),)], "json string"))
    assert [r.title for r in got.collect()] == ["T"]
    assert {r.title: r.extract for r in src.wiki_extracts(spark.createDataFrame([(json.dumps(page),)], "json string"), 0).collect()}["V"] == "(no extract)"
    old, new = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2, "x")], "id long, reject_reason string")
    assert sorted(tuple(r) for r in src.migrate(old, new).collect()) == [(1, None), (2, "x")]
    for d, size in (("p", 2 << 20), ("q", 10)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "m.gguf").write_bytes(b"x" * size)
    assert [(r.name, r.mb) for r in src.files(spark, [str(tmp_path / "p"), str(tmp_path / "q")]).collect()] == [("m.gguf", 2.0)]


def test_events_are_inserted_once(spark, tmp_path):
    path = str(tmp_path / "events")
    batch = spark.createDataFrame([(1, "2024-01-01T10:00:00.123Z", "accepted"), (2, "2024-01-01 10:00:01", "rejected")], "id long, timestamp string, event_type string")
    assert src.insert_events(batch, path, "b1") == 2
    assert src.insert_events(batch, path, "b1") == 2  # a batch that is sent again replaces itself
    assert src.insert_events(batch.limit(0), path, "b2") == 0
    got = src.inserted_events(spark, path)
    assert got.count() == 2 and str(got.orderBy("id").first().timestamp) == "2024-01-01 10:00:00"


def test_landing_stream(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    for k in range(3):
        (tmp_path / f"landing/{k}.json").write_text(json.dumps({"id": k, "timestamp": "2024-01-01T10:00:00", "event_type": "suggested"}))
    from tallgrass.streaming import telemetry

    stream = src.landing_stream(spark, str(tmp_path / "landing"))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(telemetry.distinct_events(stream.select("id", "timestamp", "event_type")), "landed")
    assert spark.table("landed").count() == 3
    (tmp_path / "text").mkdir()
    (tmp_path / "text/a.txt").write_text("keep this line\n\none\n")
    run(telemetry.filter_lines(spark.readStream.text(str(tmp_path / "text"))), "filtered")
    assert [r.value for r in spark.table("filtered").collect()] == ["keep this line"]


def test_reports(spark, tmp_path):
    summary = spark.createDataFrame([("src0", 10, 2.5), ("all", 20, 3.0)], "source string, lines long, pct double")
    reports.write_json(summary, str(tmp_path / "summary"), {"run": "r1"})
    got = json.loads(spark.read.text(str(tmp_path / "summary")).first().value)
    assert got["run"] == "r1" and sorted(r["source"] for r in got["rows"]) == ["all", "src0"]
    text = reports.markdown("Audit", summary.orderBy("source"), limit=5)
    assert text.splitlines()[0] == "# Audit" and "| src0 | 10 | 2.5 |" in text
    pairs = spark.createDataFrame([(n, f"p{n}", f"old{n}", f"new{n}") for n in range(30)], "n int, prompt string, old string, new string")
    reports.write_blinded(pairs, str(tmp_path / "ab"), seed="42")
    blind, key = (spark.read.json(str(tmp_path / "ab" / x)).orderBy("n").collect() for x in ("blinded", "key"))
    assert all((b.completion_A == f"old{b.n}") == k.A_is_old for b, k in zip(blind, key)) and 0 < sum(k.A_is_old for k in key) < 30
    assert "old" not in " ".join(blind[0].asDict())


def test_configuration():
    assert reports.configured({"a": 1, "m": {"x": 1, "y": 2}}, {"m": {"y": 3}, "b": None}, {"a": None, "b": 5}) == {"a": 1, "b": 5, "m": {"x": 1, "y": 3}}
