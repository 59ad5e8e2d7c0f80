"""Rotated JSON Lines, written so that a failed run leaves no output behind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.keyed_chunks import NUMBER
from chronoweave.storage import materialize


def line_bytes(value: str = "value") -> F.Column:
    """UTF-8 bytes of a line with its line feed."""
    return F.octet_length(value).cast("long") + 1


def rotate_by_lines(lines: DataFrame, order: list[str], max_lines: int) -> DataFrame:
    """Adds ``file``, from 1: a file is closed after ``max_lines`` lines of the total order."""
    return _numbered(lines, order).withColumn("file", F.floor(F.col(NUMBER) / max_lines) + 1).drop(NUMBER)


def _numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """Global row numbers of a total order: ranges are sorted on their own and offset by the counts of those before.

    The sorted ranges are written once, with a number that says range and place in it; nothing is shuffled or sorted again.
    """
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(NUMBER, place + F.col("_before")).drop("_part", "_id", "_before")


def rotate_by_bytes(sizes: DataFrame, order: list[str], max_bytes: int, max_lines: int | None = None) -> DataFrame:
    """(order…, n_bytes, file): a file is closed once it holds ``max_bytes`` or more; the excess is not carried over.

    The fold over the total order is inherently sequential, but it needs the sizes only: they stream through one task a
    batch at a time, never held together, while the lines themselves stay where they are.
    """
    columns = [*order, "n_bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.select(*columns).schema.fields) + ", file bigint"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held, count = 1, 0, 0
        for frame in frames:
            numbers = []
            for size in frame["n_bytes"]:
                numbers.append(file)
                held, count = held + int(size), count + 1
                if held >= max_bytes or max_lines is not None and count >= max_lines:
                    file, held, count = file + 1, 0, 0
            yield frame.assign(file=numbers)

    return sizes.select(*columns).orderBy(*order).coalesce(1).sortWithinPartitions(*order).mapInPandas(fold, schema)


def write_json_lines(lines: DataFrame, directory: str, prefix: str, stamp: str) -> dict[str, int]:
    """Writes (value, file) as ``prefix-stamp-NNNNNN.jsonl`` and returns the counts of files, records and bytes.

    Each file is written by one task, as its lines are to be in one place; all go into a hidden folder and are renamed by
    the file system only when everything is there. Nothing passes through the driver; no lines, no files.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    draft = f"{directory.rstrip('/')}/.{prefix}-{stamp}.tmp"
    fs = path(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(draft), True)
    order = [c for c in lines.columns if c not in ("value", "file")]
    laid = lines.repartition(F.col("file")).sortWithinPartitions("file", *order).select("file", "value")
    counted = Observation(f"lines {stamp}")
    laid = laid.observe(counted, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(line_bytes()), F.lit(0)).alias("bytes"))
    laid.write.partitionBy("file").text(draft)
    folders = sorted(int(f.getPath().getName()[5:]) for f in fs.listStatus(path(draft)) if f.getPath().getName().startswith("file="))
    for number in folders:
        parts = [f.getPath() for f in fs.listStatus(path(f"{draft}/file={number}")) if f.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"file {number} was written in {len(parts)} parts")
        target = path(f"{directory.rstrip('/')}/{prefix}-{stamp}-{number:06d}.jsonl")
        fs.delete(target, False)
        if not fs.rename(parts[0], target):
            raise RuntimeError(f"{target.toString()} could not be put in place")
    fs.delete(path(draft), True)
    got = counted.get if folders else {"records": 0, "bytes": 0}
    return {"files": len(folders), "records": got["records"], "bytes": got["bytes"]}
