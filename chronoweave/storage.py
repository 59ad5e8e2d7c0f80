"""Where intermediate results go so that a lost executor can't take them along."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is made and set as the checkpoint folder. A cluster's
    executors can't reach such a folder, so there a session without one is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; ``clean`` removes what lies there."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def clean(spark: SparkSession) -> int:
    """Removes all intermediate tables made so far, to be called once no result that reads them is needed any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    removed = 0
    while _made:
        path = hadoop(_made.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage is cut and nothing is computed twice."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
