"""Per-key processing without hot tasks: exact offset chunking.

Every row of a key gets its exact number 0, 1, 2, … in input order and thereby belongs to chunk ``number // chunk_rows``.
No task ever handles more than ``chunk_rows`` rows of one key; chunk states are then merged in order of the chunks.

1. Count the rows of each key in each input split (map-side; one row per split and key is shuffled).
2. Prefix sums of these counts give each split's first number within the key.
3. A split numbers its own rows from there; only the counts travel, never the rows of a hot key to one place.
4. Rows are aggregated by (key, chunk), again map-side first.
5. The ordered chunk states of a key are merged; running totals at the chunk boundaries come from their prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronoweave.storage import materialize

SPLIT, NUMBER, CHUNK = "_split", "_number", "_chunk"
CHUNK_ROWS = 100_000


def _with_split(df: DataFrame) -> DataFrame:
    return df.withColumn(SPLIT, F.spark_partition_id())


def _local_numbers(keys: list[str]):
    """Numbers rows within (split, key), in the order in which the split delivers them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            numbers = []
            for key in zip(*columns, strict=True):
                at = seen.get(key, 0)
                numbers.append(at)
                seen[key] = at + 1
            arrays = [*batch.columns, pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, NUMBER])

    return number


def split_offsets(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _split, _before, _total): rows of the key in earlier splits, and in all."""
    counts = _with_split(df).groupBy(*keys, SPLIT).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = F.sum("_n").over(by_key.orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*keys, SPLIT, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by_key).alias("_total"))


def number_rows(df: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_number`` (0-based, exact and gapless within a key) and ``_chunk``.

    ``df`` must deliver the same rows in the same splits when read twice, as a file scan with narrow steps does. Keys may
    be null (null is a key of its own). Keys that fit one chunk need no offset for their chunk, but get exact numbers all
    the same. An empty table gives an empty result; other columns pass through; a column already named ``_split``,
    ``_number`` or ``_chunk`` is refused.
    """
    if clash := {SPLIT, NUMBER, CHUNK, "_before", "_total"} & set(df.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    schema = T.StructType([*_with_split(df).schema.fields, T.StructField(NUMBER, T.LongType())])
    rows = _with_split(df).mapInArrow(_local_numbers(keys), schema)
    offsets = split_offsets(df, keys).select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(SPLIT).alias("_o_split"), "_before")
    same = F.col(SPLIT) == F.col("_o_split")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    number = F.col(NUMBER) + F.col("_before")
    return rows.join(offsets, same).select(*df.columns, number.alias(NUMBER), F.floor(number / chunk_rows).cast("long").alias(CHUNK))


def _chunk_of_rows(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Like ``number_rows``, but only ``_chunk``: a key of one chunk has chunk 0 and needs no offset.

    Keys of several chunks number at most rows / chunk_rows. Their offsets are written first, so that their size is known
    when the join is planned: below the session's broadcast threshold no row is shuffled, above it the join is sorted.
    """
    schema = T.StructType([*_with_split(df).schema.fields, T.StructField(NUMBER, T.LongType())])
    rows = _with_split(df).mapInArrow(_local_numbers(keys), schema)
    offsets = split_offsets(df, keys).filter(F.col("_total") > chunk_rows)
    offsets = materialize(offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(SPLIT).alias("_o_split"), "_before"), "offsets")
    same = F.col(SPLIT) == F.col("_o_split")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    chunk = F.floor((F.col(NUMBER) + F.col("_before")) / chunk_rows).cast("long")
    return rows.join(offsets, same, "left").select(*df.columns, F.coalesce(chunk, F.lit(0)).alias(CHUNK))


def chunk_states(df: DataFrame, keys: list[str], sums: list[str], order: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key and chunk: rows, sums, first/last ``order`` value, and running totals before the chunk."""
    numbered = _chunk_of_rows(df.select(*dict.fromkeys([*keys, *sums, *([order] if order else [])])), keys, chunk_rows)
    aggregates = [F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]]
    if order:
        aggregates += [F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}")]
    states = numbered.groupBy(*keys, F.col(CHUNK).alias("chunk")).agg(*aggregates)
    ahead = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    running = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("n_rows", *sums)]
    return states.select("*", *running)


def per_key(df: DataFrame, keys: list[str], sums: list[str], order: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Complete per-key results from the ordered chunk states.

    Nulls in ``sums`` count as nothing; a key with nulls only sums to 0. Repeated rows all count. A key's number of chunk
    states is its rows / ``chunk_rows``, so merging them is light even for a key that holds a third of a table.
    """
    states = chunk_states(df, keys, sums, order, chunk_rows)
    merged: list[Column] = [F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_chunks")]
    if order:
        merged += [F.min(f"first_{order}").alias(f"first_{order}"), F.max(f"last_{order}").alias(f"last_{order}")]
    return states.groupBy(*keys).agg(*merged)


def heavy_keys(df: DataFrame, keys: list[str], share: float, total_rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys with at least ``share`` of ``total_rows`` rows, with their counts."""
    return per_key(df, keys, [], None, chunk_rows).filter(F.col("n_rows") >= share * total_rows)
