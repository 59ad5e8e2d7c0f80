"""Parquet tables of an extraction run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_email(column) -> F.Column:
    """E-mail as a key: trimmed, lower case, null where nothing is left."""
    email = F.lower(F.trim(column))
    return F.when(email != "", email)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of several rows of one key the one with the latest ``by``; ties go to any, all columns from the same row.

    The rows of one key are re-extractions of one fact, so the aggregate combines map-side and no window is needed.
    """
    rest = [c for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_held"))
    return held.select(*keys, *[F.col("_held")[c].alias(c) for c in rest])
