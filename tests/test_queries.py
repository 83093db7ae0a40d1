"""Registered queries against DuckDB on the smallest tables (the training-data ones have tests of their own)."""

import math

import duckdb
import pytest

from tallgrass.plans import corpus, evaluation, keyboard, preparation, registry  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in registry.ORACLE:
        found = duck.execute(registry.ORACLE[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(norm(x[names.index(c)]) for c in columns) for x in found.fetchall())
