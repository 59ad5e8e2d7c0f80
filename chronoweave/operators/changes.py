"""File changes of commits: tree differences, guards and line counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.schemas import BLOB_MODES

BINARY_PREFIX = 8_000


def tree_changes(trees: DataFrame, commits: DataFrame) -> DataFrame:
    """(oid, path, status, before_oid, after_oid, before_mode, after_mode) against the first parent.

    ``trees`` has (oid, path, blob_oid, mode), ``commits`` (oid, parents). Only file blobs count on either side, so what
    turns into a tree or gitlink is deleted. Entries of equal blob and mode are no change; renames are a deletion and an
    addition; a commit without a known parent adds everything.
    """
    blobs = trees.filter(F.col("mode").isin(*BLOB_MODES))
    parent = commits.select("oid", F.get("parents", F.lit(0)).alias("parent"))
    after = parent.select("oid").join(blobs, "oid").select("oid", "path", F.col("blob_oid").alias("after_oid"), F.col("mode").alias("after_mode"))
    before = parent.filter("parent IS NOT NULL").join(blobs.withColumnRenamed("oid", "parent"), "parent")
    before = before.select("oid", "path", F.col("blob_oid").alias("before_oid"), F.col("mode").alias("before_mode"))
    both = after.join(before, ["oid", "path"], "full_outer")
    same = F.col("before_oid").eqNullSafe(F.col("after_oid")) & F.col("before_mode").eqNullSafe(F.col("after_mode"))
    status = F.when(F.col("before_mode").isNull(), "added").when(F.col("after_mode").isNull(), "deleted").otherwise("modified")
    return both.filter(~same).select("oid", "path", status.alias("status"), "before_oid", "after_oid", "before_mode", "after_mode")


def is_binary(content: Column) -> Column:
    """Whether there is a NUL in the first 8,000 bytes; null content has none."""
    head = F.decode(F.substring(content, 1, BINARY_PREFIX), "ISO-8859-1")
    return F.coalesce(F.instr(head, "\u0000") > 0, F.lit(False))


def diff_guard(before: Column, after: Column, most_bytes: int | None = None) -> Column:
    """Why a pair of contents is not diffed: ``size`` (asked first), ``binary``, or null."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    too_large = F.lit(False) if most_bytes is None else (size(before) > most_bytes) | (size(after) > most_bytes)
    return F.when(too_large, "size").when(is_binary(before) | is_binary(after), "binary")


def _lines(content: bytes | None) -> list[str]:
    if not content:
        return []
    text = bytes(content).decode("utf-8", "replace")
    lines = text.removeprefix("﻿").split("\n")
    last = lines.pop()
    return [line + "\n" for line in lines] + ([last] if last else [])


def changed_lines(before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """(additions, deletions) of a minimal line script: what each side has beyond their longest common subsequence.

    Equal ends are cut off; the length is then computed with one machine-independent big integer a row, whose bits say
    where the subsequence grows.
    """
    a, b = _lines(before), _lines(after)
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        match = row & places.get(line, 0)
        row = (row + match | row - match) & full
    common = len(a) - row.bit_count()
    return len(b) - common, len(a) - common


COUNTS = T.StructType([T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType())])


@F.pandas_udf(COUNTS)
def line_counts(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Additions and deletions of two binary columns; null content is an absent file."""
    return pd.DataFrame([changed_lines(x, y) for x, y in zip(before, after, strict=True)], columns=["additions", "deletions"])


def with_line_counts(changes: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Adds additions, deletions and ``skipped`` (size, binary or null) to changes with before_content and after_content.

    Guarded pairs never reach the Python worker: their contents are nulled before the call.
    """
    guard = diff_guard(F.col("before_content"), F.col("after_content"), most_bytes)
    marked = changes.withColumn("skipped", guard)
    kept = lambda c: F.when(F.col("skipped").isNull(), F.col(c))
    counted = marked.withColumn("_counts", line_counts(kept("before_content"), kept("after_content")))
    number = lambda c: F.when(F.col("skipped").isNull(), F.col(f"_counts.{c}")).alias(c)
    return counted.select(*changes.columns, number("additions"), number("deletions"), "skipped")
