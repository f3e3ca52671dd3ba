"""The panel operators on Structured Streaming.

Every query runs with ``availableNow`` over a file source and keeps its
checkpoint and its output in the shared folder, so a restarted run continues
where the last one stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.entities import dedupe_most_complete
from tessella.session import scratch_path


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files below a path (file, folder or glob) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    glob = path if any(ch in path for ch in "*?[") else f"{path[:-1]}[{path[-1]}]"
    return reader.parquet(glob)


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; stored times are read as they are."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch replaces its own folder: no row is written twice.
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, name: str, mode: str, work: str | None = None) -> str:
    """Process all files present, once; returns the output folder."""
    work = work or scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(_write_batch(f"{work}/table"))
        .start()
    )
    query.awaitTermination()
    return f"{work}/table"


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def latest_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run in update mode and keep every key's last emitted row."""
    path = run_available(stream, name, "update")
    rows = read_batches(stream.sparkSession, path, stream.schema)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id")


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run in append mode: only final rows are written."""
    path = run_available(stream, name, "append")
    return read_batches(stream.sparkSession, path, stream.schema).drop("batch_id")


def ingest_snapshots(stream: DataFrame, work: str) -> str:
    """Append newly arrived files to a batch log, each exactly once.

    The same ``work`` folder continues an earlier run: files already logged
    are skipped.
    """
    return run_available(stream, "ingest", "append", work)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Subfolders of ``folder`` whose write was committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().getName() for f in found or [])


@dataclass(frozen=True)
class Manifest:
    """The state of a compacted log: the live snapshot and the last batch in it."""

    version: int
    snapshot: str
    files: int
    rows: int
    through: int


MANIFEST = "version long, snapshot string, files long, rows long, through long"


def manifest(spark: SparkSession, log: str) -> Manifest | None:
    """The newest committed manifest of a batch log."""
    versions = _complete(spark, f"{_beside(log)}/manifests")
    if not versions:
        return None
    return Manifest(**spark.read.schema(MANIFEST).json(f"{_beside(log)}/manifests/{versions[-1]}").first().asDict())


def _beside(log: str) -> str:
    return log.rsplit("/", 1)[0]


def live_rows(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """Rows of the live snapshot and of the batches after it, with ``batch_id``."""
    newest = manifest(spark, log)
    rows = read_batches(spark, log, schema)
    if newest is None:
        return rows
    folded = spark.read.schema(rows.schema).parquet(f"{_beside(log)}/snapshots/{newest.snapshot}")
    return folded.unionByName(rows.filter(F.col("batch_id") > newest.through))


def _fullest(rows: DataFrame, keys: list[str], data_cols: list[str]) -> DataFrame:
    return dedupe_most_complete(rows, keys, data_cols, [F.desc("batch_id"), *data_cols])


def write_snapshot(spark: SparkSession, log: str, schema: T.StructType, keys: list[str], data_cols: list[str]) -> str | None:
    """Fold the live rows into a new snapshot folder, which nothing reads yet."""
    batches = _complete(spark, log)
    newest = manifest(spark, log)
    last = max((int(b.removeprefix("batch_id=")) for b in batches), default=-1)
    if last <= (newest.through if newest else -1):
        return None  # no batch since
    name = f"through-{last:012d}-{uuid.uuid4().hex}"
    _fullest(live_rows(spark, log, schema).filter(F.col("batch_id") <= last), keys, data_cols).write.parquet(f"{_beside(log)}/snapshots/{name}")
    return name


def compact(spark: SparkSession, log: str, schema: T.StructType, keys: list[str], data_cols: list[str]) -> Manifest | None:
    """Fold all batches so far into one snapshot; views then read it and newer
    batches only.

    Two committed writes, in this order: the snapshot, under a name never used
    before, and a manifest that names it and the last batch in it.  A run lost
    before the second leaves a snapshot that no manifest names and the state
    unchanged.  One compaction of a log at a time; ingestion may go on.
    """
    name = write_snapshot(spark, log, schema, keys, data_cols)
    if name is None:
        return manifest(spark, log)
    folder = f"{_beside(log)}/snapshots/{name}"
    snapshot = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(folder)
    newest = manifest(spark, log)
    # The name carries the last batch: a snapshot and its reach are one thing.
    new = Manifest(newest.version + 1 if newest else 0, name, len(snapshot.inputFiles()), snapshot.count(), int(name.split("-")[1]))
    path = f"{_beside(log)}/manifests/{new.version:012d}"
    spark.createDataFrame([astuple(new)], MANIFEST).coalesce(1).write.mode("overwrite").json(path)
    return new


def remove_folded(spark: SparkSession, log: str) -> None:
    """Delete batches and snapshots that the newest manifest makes superfluous.

    For when no view made before the last compaction is read any more.
    """
    newest = manifest(spark, log)
    if newest is None:
        return
    old = [f"{log}/{b}" for b in _complete(spark, log) if int(b.removeprefix("batch_id=")) <= newest.through]
    old += [f"{_beside(log)}/snapshots/{s}" for s in _complete(spark, f"{_beside(log)}/snapshots") if s != newest.snapshot and s < newest.snapshot]
    for folder in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def current_rows(
    spark: SparkSession, log: str, schema: T.StructType, keys: list[str], data_cols: list[str]
) -> DataFrame:
    """Upsert view of a batch log: fullest row per key, newest batch on ties.

    Reads the live snapshot, if the log has been compacted, and newer batches.
    """
    return _fullest(live_rows(spark, log, schema), keys, data_cols).drop("batch_id")


def tumbling_mean(
    stream: DataFrame, ts: str, value: str, keys: list[str], size: str, lateness: str
) -> DataFrame:
    """Mean per fixed window; rows later than the watermark are dropped."""
    w = F.window(ts, size)
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(w.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "mean_value")
    )


def sliding_stats(
    stream: DataFrame, ts: str, value: str, keys: list[str], size: str, slide: str, lateness: str
) -> DataFrame:
    """Mean and sample deviation per sliding window."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, size, slide).alias("w"), *keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(value).alias("mean_value"),
            F.stddev_samp(value).alias("std_value"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "n", "mean_value", "std_value")
    )


def silence_gaps(stream: DataFrame, ts: str, entity: str, gap: str, lateness: str) -> DataFrame:
    """Activity sessions closed by at least ``gap`` of silence.

    A session is emitted once the watermark has passed its end, i.e. once the
    entity is known to have been silent.
    """
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap).alias("s"), entity)
        .agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"))
        .select(entity, F.col("s.start").alias("first_seen"), "last_seen", F.col("s.end").alias("silent_from"), "n")
    )


def first_per_period(stream: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """Suppress repeated keys that arrive within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def enrich(stream: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join a stream with a static table; its size decides the strategy."""
    return stream.join(static, keys, "left")


def window_key(ts: Column, size: str) -> Column:
    return F.window(ts, size)["start"]
