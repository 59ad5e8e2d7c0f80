"""Streams into tables that are kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.operators.sessions import SessionTable
from chronoweave.sources.tables import clean_email


def session_sink(table: SessionTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for batches of (event_id, key, ts).

    A batch that Spark delivers again after a failure changes nothing, as the table knows its events by their ids; late
    events merge into old sessions, so no watermark is needed and none is dropped.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table.apply(batch.select("event_id", "key", "ts"))

    return apply


def commit_events(commits: DataFrame) -> DataFrame:
    """(event_id, key, ts) of commits (oid, author): what the author's e-mail did when."""
    return commits.select(F.col("oid").alias("event_id"), clean_email(F.col("author.email")).alias("key"), F.col("author.timestamp").alias("ts"))


def stream_sessions(commits: DataFrame, table: SessionTable, checkpoint: str) -> StreamingQuery:
    """Keeps the session table up to date with a stream of commits, such as the git source's."""
    return commit_events(commits).writeStream.foreachBatch(session_sink(table)).option("checkpointLocation", checkpoint).start()
