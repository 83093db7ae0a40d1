"""Fixtures of the training-data tests: awkward rows that every operator must bear."""

import pytest

SMALL = "/root/testdata/sf0.001"

#: Null, empty and very long texts, ties, repeated rows, null and repeated ids, a clashing extra column.
LONG = "alpha beta gamma delta " * 6000
ODD = [
    (1, None, "x", 1), (2, "", "x", 1), (3, " \n\t ", "x", 2), (4, "one", "y", 2), (5, "one two", "y", 3), (6, "one two three four five six", "y", 3),
    (6, "one two three four five six", "y", 3), (7, "one two three four five six", "y", 4), (None, "no id here at all", "z", 4), (None, None, "z", 5), (8, LONG, "z", 5), (9, LONG, None, 6),
]


@pytest.fixture(scope="session", autouse=True)
def surrogate_key(spark):
    """Tests that name no key use the session's."""
    spark.conf.set("spark.tallgrass.surrogates.key", "of the tests")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, key string, fp long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, fp long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
