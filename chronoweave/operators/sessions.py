"""Incremental session table.

A session is a maximal run of one key's events in which neighbours are at most ``gap`` seconds apart. The table takes
batches of events in any order, late ones too: each batch is cut into local sessions, these meet the stored sessions
within the gap, bridged ones become one, and the affected rows are replaced in a new version of the table that becomes
current by one rename. Sessions lie in cells of (bucket of keys, epoch of their start), and only cells that the batch's
sessions touch are read and written, so the work follows the batch and not the table.

A key with a third of all events is no problem: events are first counted by (key, time cell of the width of the gap).
All events of a cell belong to one session by definition, so what is left of a key is bounded by the time it spans.
Cells are chained within epochs of many cells, and epochs are joined only at their edges.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.storage import materialize, new_path

GAP_SECONDS = 7_200
EPOCH_CELLS = 4_096
EPOCH_SECONDS = 180 * 86_400
EVENT = "event_id string, key string, ts bigint"
SESSION = "key string, start_ts bigint, end_ts bigint, n_events bigint"


def _chain(spans: DataFrame, gap: int, by: list[str]) -> DataFrame:
    """Joins spans (start_ts, end_ts, n_events) of one ``by`` group that lie within the gap of what came before."""
    order = Window.partitionBy(*by).orderBy("start_ts", "end_ts")
    reach = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_opens", (reach.isNull() | (F.col("start_ts") - reach > gap)).cast("int"))
    numbered = opened.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_events").cast("long").alias("n_events")
    ).drop("_run")


def merge_spans(spans: DataFrame, gap: int = GAP_SECONDS, epoch_cells: int = EPOCH_CELLS) -> DataFrame:
    """Maximal sessions of spans that are themselves sessions or parts of such; input and output are of ``SESSION``.

    A span that crosses epochs is cut at their borders into touching pieces, the first of which keeps the count. Pieces
    are chained within (key, epoch). A run of one epoch can then only continue in another if it is the epoch's first or
    last, so only two runs an epoch enter the second chaining.
    """
    width = max(gap, 1) * epoch_cells
    epoch = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    pieces = spans.withColumn("_epoch", F.explode(F.sequence(epoch("start_ts"), epoch("end_ts")))).select(
        "key", "_epoch",
        F.greatest("start_ts", F.col("_epoch") * width).alias("start_ts"),
        F.least("end_ts", (F.col("_epoch") + 1) * width).alias("end_ts"),
        F.when(F.col("_epoch") == epoch("start_ts"), F.col("n_events")).otherwise(0).alias("n_events"),
    )
    runs = _chain(pieces, gap, ["key", "_epoch"])
    by_epoch = Window.partitionBy("key", "_epoch")
    edges = runs.withColumn("_first", F.col("start_ts") == F.min("start_ts").over(by_epoch)).withColumn("_last", F.col("end_ts") == F.max("end_ts").over(by_epoch))
    inner = edges.filter(~F.col("_first") & ~F.col("_last"))
    joined = _chain(edges.filter(F.col("_first") | F.col("_last")), gap, ["key"])
    columns = ["key", "start_ts", "end_ts", "n_events"]
    return inner.select(*columns).unionByName(joined.select(*columns))


def local_sessions(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Sessions of one batch of (key, ts). Rows whose key or time is null belong to no session; ties are separate events.

    Counting by time cell combines map-side, so a hot key shuffles one row per split and cell. A cell is of ``gap``
    seconds, hence neighbours within one are less than ``gap`` apart. An empty batch has no sessions.
    """
    cell = F.floor(F.col("ts") / F.lit(max(gap, 1))).cast("long")
    cells = events.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).groupBy("key", cell.alias("_cell")).agg(
        F.min("ts").cast("long").alias("start_ts"), F.max("ts").cast("long").alias("end_ts"), F.count(F.lit(1)).alias("n_events")
    )
    return merge_spans(cells.drop("_cell"), gap)


class SessionTable:
    """Versions of a session table, with the ids of the events it holds, in a folder all executors can reach.

    ``apply(batch)`` takes (event_id, key, ts). Events that the table holds are left out, as are ids repeated within the
    batch, so a batch that is applied twice changes nothing. An event is known again by id, key and time, so ids are looked
    up in the cells of their own time only; null ids are one id.

    A version is a manifest: for every cell the time its sessions span and the folder that holds its sessions and events.
    A writer puts its cells into a folder of its own and commits by renaming its manifest to the next version's name, which
    fails if another writer has it. Readers see the state before or after, never a part; what an attempt that failed has
    written is named by no manifest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, gap: int = GAP_SECONDS, buckets: int = 4, epoch_seconds: int = EPOCH_SECONDS):
        self.spark, self.path, self.gap, self.buckets, self.epoch_seconds = spark, path or new_path(spark, "sessions"), gap, buckets, epoch_seconds
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jpath = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._jpath(self.path))

    def version(self) -> int:
        """The newest committed version, 0 for none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())])

    def _manifest(self, version: int) -> list[dict]:
        """One entry a cell: bucket, epoch, the span low … high of what it holds, n_sessions, and its folder."""
        if not version:
            return []
        lines = self.spark.read.text(f"{self.path}/v{version}.json").collect()
        return [json.loads(line["value"]) for line in lines]

    def _read(self, cells: list[dict], what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{c['folder']}/{what}/bucket={c['bucket']}/epoch={c['epoch']}" for c in cells if what == "events" or c["n_sessions"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self._manifest(self.version()), "sessions", SESSION)

    def _cell(self, ts: str) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"), F.floor(F.col(ts) / self.epoch_seconds).cast("long").alias("epoch")

    def _write(self, rows: DataFrame, folder: str, what: str, ts: str) -> None:
        columns = rows.columns
        rows.select("*", *self._cell(ts)).hint("rebalance", "bucket", "epoch").select(*columns, "bucket", "epoch").write.partitionBy("bucket", "epoch").parquet(f"{self.path}/{folder}/{what}")

    def apply(self, batch: DataFrame) -> int:
        """Merges a batch and returns the new version."""
        at = self.version()
        folder = f"d{uuid.uuid4().hex}"
        given = batch.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(F.col("event_id").cast("string").alias("event_id"), "key", F.col("ts").cast("long").alias("ts"))
        given = materialize(given.groupBy("event_id").agg(F.min_by(F.struct("key", "ts"), F.struct("ts", "key")).alias("_e")).select("event_id", "_e.key", "_e.ts"), "given")
        manifest = self._manifest(at)
        bucket, epoch = self._cell("ts")
        # the cells that the batch's events lie in hold their ids, those whose span they come near hold the sessions they meet
        reach = given.groupBy(bucket, epoch).agg((F.min("ts") - self.gap).alias("first"), (F.max("ts") + self.gap).alias("last")).collect()
        touched = [c for c in manifest if any(r["bucket"] == c["bucket"] and (r["epoch"] == c["epoch"] or c["low"] <= r["last"] and c["high"] >= r["first"]) for r in reach)]
        held = self._read(touched, "events", EVENT)
        known = held.select(F.col("event_id").alias("_id"), F.col("key").alias("_key"), F.col("ts").alias("_ts"))
        fresh = given.join(known, F.col("event_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("ts") == F.col("_ts")), "left_anti")
        fresh = materialize(fresh, "fresh") if touched else given
        local = materialize(local_sessions(fresh, self.gap), "local")
        stored = self._read(touched, "sessions", SESSION)
        merged = self._merge(stored, local) if touched else local
        self._write(merged, folder, "sessions", "start_ts")
        self._write(held.unionByName(fresh), folder, "events", "ts")
        cells: dict[tuple[int, int], dict] = {}
        for what, low, high in (("sessions", "start_ts", "end_ts"), ("events", "ts", "ts")):  # a cell can have events only
            written = self.spark.read.schema(f"{low} bigint, {high} bigint, bucket int, epoch bigint" if low != high else f"{low} bigint, bucket int, epoch bigint").parquet(f"{self.path}/{folder}/{what}")
            for r in written.groupBy("bucket", "epoch").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n")).collect():
                new = {"bucket": r["bucket"], "epoch": r["epoch"], "low": r["low"], "high": r["high"], "n_sessions": r["n"] if what == "sessions" else 0, "folder": folder}
                old = cells.setdefault((r["bucket"], r["epoch"]), new)
                old["low"], old["high"] = min(old["low"], new["low"]), max(old["high"], new["high"])
        replaced = {(c["bucket"], c["epoch"]) for c in touched}
        self._commit([c for c in manifest if (c["bucket"], c["epoch"]) not in replaced] + list(cells.values()), at + 1)
        return at + 1

    def _commit(self, manifest: list[dict], version: int) -> None:
        draft, final = (self._fs.makeQualified(self._jpath(f"{self.path}/{name}")) for name in (f".draft-{uuid.uuid4().hex}", f"v{version}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(c) + "\n" for c in manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # unlike FileSystem.rename this never goes over or into what is there
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer") from error

    def _merge(self, stored: DataFrame, local: DataFrame) -> DataFrame:
        """Stored sessions near a local one are merged with it; all others pass through untouched.

        Near is decided by coarse time cells of both sides: a stored session is affected if it covers or adjoins a cell
        that a local session of its key covers or adjoins. Sessions that meet a cell without being within the gap come
        out of the merge as they went in, so a coarse match costs work but can't change the result.
        """
        wide = self.gap * 16
        cells = lambda: F.explode(F.sequence(F.floor((F.col("start_ts") - self.gap) / wide), F.floor((F.col("end_ts") + self.gap) / wide)))
        touched = local.select("key", cells().alias("_cell")).distinct()
        met = stored.select("key", "start_ts", cells().alias("_cell")).join(touched, ["key", "_cell"], "left_semi").select("key", "start_ts", F.lit(True).alias("_met")).distinct()
        marked = stored.join(met, ["key", "start_ts"], "left")
        columns = ["key", "start_ts", "end_ts", "n_events"]
        affected = marked.filter("_met").select(*columns)
        return marked.filter("_met IS NULL").select(*columns).unionByName(merge_spans(affected.unionByName(local.select(*columns)), self.gap))


def sessions_in_batches(events: DataFrame, arrival: str, n_batches: int = 3, gap: int = GAP_SECONDS, path: str | None = None) -> DataFrame:
    """All sessions of (event_id, key, ts, arrival), built by applying the events to a session table in order of arrival.

    The batches are cut at quantiles of ``arrival``; rows without an arrival time come with the last batch. Where the
    cuts lie can't change the result, only the sizes of the batches, so approximate quantiles do.
    """
    table = SessionTable(events.sparkSession, path, gap)
    seconds = F.unix_micros(F.col(arrival).cast("timestamp"))
    cuts = events.select(F.percentile_approx(seconds, [i / n_batches for i in range(1, n_batches)], 1000)).head()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = F.lit(True)
        if low is not None:
            part = seconds > low if high is not None else (seconds > low) | seconds.isNull()
        if high is not None:
            part = part & (seconds <= high)
        table.apply(events.filter(part).select("event_id", "key", "ts"))
    return table.read()
