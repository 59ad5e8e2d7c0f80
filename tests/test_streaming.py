"""A stream of commits into the session table, and cleaning up after runs."""

import os

from pyspark.sql import functions as F

from chronoweave import storage
from chronoweave.operators.sessions import SessionTable
from chronoweave.streaming.sinks import stream_sessions

COMMITS = "oid string, author struct<email:string,timestamp:bigint>"


def test_sessions_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    table = SessionTable(spark, str(tmp_path / "table"), gap=100)
    first = [("a", (" A@x ", 0)), ("b", ("a@x", 250)), ("c", (None, 5))]
    late = [("d", ("a@X", 90)), ("e", ("a@x", 170)), ("a", ("a@x", 0)), ("f", ("b@x", 7))]
    for rows in (first, late, []):
        if rows:
            spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(source)
        query = stream_sessions(spark.readStream.schema(COMMITS).parquet(source), table, str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
        if rows is first:
            assert sorted(map(tuple, table.read().collect())) == [("a@x", 0, 0, 1), ("a@x", 250, 250, 1)]
    assert sorted(map(tuple, table.read().collect())) == [("a@x", 0, 250, 4), ("b@x", 7, 7, 1)]


def test_intermediate_tables_are_removed(spark):
    df = storage.materialize(spark.range(5).withColumn("x", F.lit(1)), "probe")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    assert storage.clean(spark) > 0 and not os.path.exists(path)
