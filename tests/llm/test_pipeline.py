"""The pipeline as a whole: every stage's rows against plain versions, on the small corpus with awkward rows added."""

from collections import Counter

import numpy as np
import pytest
from test_brute_force import base, plain_matches
from test_similar import plain_kept
from tokenizers import Tokenizer

import corpus_pipeline
from tallgrass.llm import rules, tiling
from tallgrass.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, documents, odd, tmp_path_factory):
    """What each stage kept, first the input: as ``run`` chains them, over the corpus and awkward rows."""
    more = odd.selectExpr("doc_id + 90000 AS doc_id", "text", "'en' AS lang", "key AS source", "cast(fp AS long) AS n_chars")
    docs = documents.unionByName(more).unionByName(more.filter("doc_id IS NULL")).unionByName(documents.limit(3))
    out, base_dir = [docs.collect()], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{base_dir}/{k}")
        docs = spark.read.parquet(f"{base_dir}/{k}")
        out.append(docs.collect())
    return out


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def test_rules_drop_what_the_base_rules_and_the_list_reject(stages, spark, labels):
    given, kept, *_ = stages
    assert not multiset(kept) - multiset(given)
    failed = Counter()
    for r in given:
        n, _, _, _, repeats = base(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            failed[tuple(r)] += 1
    assert not failed & multiset(kept)
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    listed = {(r.doc_id, r.text) for r in rules.judged(df, labels).filter("NOT _kept").collect()}
    gone = multiset(given) - multiset(kept)
    assert set(gone) == {tuple(r) for r in given if (r.doc_id, r.text) in listed} and len(gone) < len(given)


def test_one_document_of_each_group_stays(stages):
    _, given, kept, *_ = stages
    assert sorted(r.doc_id for r in kept) == plain_kept([(r.doc_id, r.text) for r in given])
    assert not multiset(kept) - multiset(given)


def test_leaking_documents_go(stages, spark):
    _, _, given, kept, *_ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [tiling.words(t)] for i in range(len(w) - 4)}
    of, leaks = {i: grams(t) for i, t in items}, set()
    assert all(of.values())  # so that a match needs a common run of five words
    for r in given:
        own = grams(r.text)
        leaks |= {m[0] for m in plain_matches([(r.doc_id, r.text)], [x for x in items if of[x[0]] & own])}
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given if r.doc_id not in leaks) and leaks


def test_mixing_repeats_and_never_drops(stages):
    *_, given, mixed, _ = stages
    assert set(multiset(given)) == set(multiset(mixed)) and not multiset(given) - multiset(mixed)


def test_ids_are_the_librarys(stages):
    *_, mixed, ids = stages
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in ids) == want
    starts = np.array(sorted((r.start, r.n_tokens) for r in ids))
    assert starts[0, 0] == 0 and (starts[1:, 0] == starts[:-1].sum(axis=1)).all()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns) and got.count() > 100
