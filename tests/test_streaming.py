"""Stream replays over several micro-batches whose files are not laid out by time."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallgrass.plans import evaluation, registry  # noqa: F401

FILES = 20  # of which a micro-batch takes 8


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The events with their times interleaved over the files, and some rows twice."""
    base = tmp_path_factory.mktemp("mixed")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events = events.unionByName(events.filter("event_id % 50 = 0"))
    events.withColumn("file", F.pmod(F.hash("event_id", F.rand(3)), F.lit(FILES))).repartition(FILES, "file").drop("file").write.option("maxRecordsPerFile", 60).parquet(f"{base}/events.parquet")
    assert len(list((base / "events.parquet").glob("*.parquet"))) > 8
    return str(base)


@pytest.mark.parametrize("name", ["stream_timeline", "stream_ignored"])
def test_replay_counts_every_row_in_time_order(spark, mixed, name):
    df = registry.QUERIES[name](spark, mixed)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{mixed}/events.parquet/*.parquet'")
    found = con.execute(registry.ORACLE[name])
    columns = [x[0] for x in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    assert want and sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want
