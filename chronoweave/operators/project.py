"""Records as they are written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.values import iso_timestamp


def person(column: str) -> Column:
    c = F.col(column)
    return F.struct(c["name"].alias("name"), c["email"].alias("email"), iso_timestamp(c["timestamp"], c["timezone_offset"]).alias("timestamp"))


def commit_records(commits: DataFrame, name: str | None = None, url: str | None = None) -> DataFrame:
    """(oid, message, author, committer, parents, repository); the run's repository replaces the row's where it is given."""
    repository = F.col("repository") if name is None else F.struct(F.lit(name).alias("name"), F.lit(url).cast("string").alias("url"))
    return commits.select("oid", "message", person("author").alias("author"), person("committer").alias("committer"), "parents", repository.alias("repository"))


def file_records(commits: DataFrame, changes: DataFrame, name: str | None = None, url: str | None = None) -> DataFrame:
    """Commit records with one row for each changed file (oid, path, status, additions, deletions); empty commits have none."""
    files = changes.select("oid", F.struct("path", "status", "additions", "deletions").alias("file"))
    return commit_records(commits, name, url).join(files, "oid").select("oid", "message", "author", "committer", "parents", "repository", "file")


def json_lines(records: DataFrame) -> DataFrame:
    """(value): one JSON object a row, nulls kept; a column that is absent stays absent."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
