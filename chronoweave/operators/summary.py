"""Summaries of spans and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def span_summary(spans: DataFrame) -> DataFrame:
    """One row a span name of (name, started, duration_ms, attribute, counters map, failed), in order of the first start."""
    base = spans.groupBy("name").agg(
        F.min("started").alias("first_started"), F.count(F.lit(1)).alias("n_spans"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"), F.sum(F.coalesce(F.col("failed").cast("int"), F.lit(0))).alias("n_errors"), F.array_sort(F.collect_set("attribute")).alias("attributes"),
    )
    counted = spans.select("name", F.explode("counters").alias("counter", "n")).groupBy("name", "counter").agg(F.sum("n").alias("n"))
    counters = counted.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n")))).alias("counters"))
    return base.join(counters, "name", "left").orderBy("first_started", "name")


def observed(records: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Records with counters that are taken as they are written: records, distinct commits, skipped diffs, bytes."""
    observation = Observation(name)
    has = set(records.columns)
    metrics = [F.count(F.lit(1)).alias("records")]
    if "skipped" in has:
        metrics.append(F.count("skipped").alias("skipped"))
    if "value" in has:
        metrics.append(F.sum(F.octet_length("value") + 1).alias("bytes"))
    return records.observe(observation, *metrics), observation
