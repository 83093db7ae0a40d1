"""Queries over all followers of a word, where the first five are not enough."""

import pytest

from tallgrass.plans import evaluation, registry  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("full"))
    words = [f"same{c}" for c in "abcdef"] + ["beta", "gamma", "theta"]  # six followers with one key, then others
    turns = [(1, i, "user", f"headword {w}") for i, w in enumerate(w for k, w in enumerate(words) for _ in range(10 - k))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{base}/conversations.parquet")
    return base


def test_all_followers(spark, folder):
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, folder).collect()]
    assert len(run("nucleus_mask")) == 9
    assert run("paradigm_rank") == [("headword", "th", 9)]
    assert sorted(r[1] for r in run("candidates_topk")) == ["beta", "gamm", "same"]
