"""Streaming jobs.  Each returns a started query; the caller waits or stops it.

The default trigger takes everything that has arrived and ends; a buffer interval
in seconds keeps the query running instead.  All progress and state lie in the
checkpoint folder, so a lost executor or driver resumes where it stopped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from fieldmart.operators import metrics
from fieldmart.operators.upsert import upsert_latest
from fieldmart.plans import bronze, mart
from fieldmart.plans.bronze import with_ingest_metadata
from fieldmart.schemas import RAW_DATASETS
from fieldmart.sources import csv, files, lake
from fieldmart.sources.csv import CORRUPT_RECORD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_backed_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, outside the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _start(writer: DataStreamWriter, checkpoint: str, buffer_seconds: int | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if buffer_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{buffer_seconds} seconds").start()


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", **options
) -> DataFrame:
    """Files arriving under ``path``; for a single file give it as a glob."""
    return spark.readStream.schema(schema).format(file_format).options(**options).load(path)


def ingest_csv(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    bronze: str,
    checkpoint: str,
    ingested_at: Column | None = None,
    max_files: int = 1000,
    buffer_seconds: int | None = None,
) -> StreamingQuery:
    """New CSV files to Bronze Parquet, each file exactly once."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT_RECORD, T.StringType())])
    rows = read_files(
        spark, landing, full, "csv",
        header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT_RECORD, enforceSchema=False,
        recursiveFileLookup=True, pathGlobFilter="*.csv", maxFilesPerTrigger=max_files,
    )
    writer = (
        with_ingest_metadata(rows, None, ingested_at)
        .writeStream.format("parquet")
        .option("path", bronze)
        .partitionBy("ingestion_date")
    )
    return _start(writer, checkpoint, buffer_seconds)


def drop_redelivered(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    delay: str = "10 minutes",
    source: str | None = None,
    spread: int = 16,
) -> DataFrame:
    """One row per key within the watermark delay.

    With ``source``, a column naming the delivery a row came with, copies are first
    dropped per (key, hash of the source): one key that makes up a third of the
    input is then spread over ``spread`` tasks, and the exact second step sees at
    most ``spread`` copies of it.
    """
    marked = rows.withWatermark(ts, delay)
    if source is None:
        return marked.dropDuplicatesWithinWatermark(list(keys))
    return (
        marked.withColumn("_spread", F.pmod(F.xxhash64(source), F.lit(spread)))
        .dropDuplicatesWithinWatermark([*keys, "_spread"])
        .dropDuplicatesWithinWatermark(list(keys))
        .drop("_spread")
    )


def rollup(rows: DataFrame, width: str, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Tumbling metric rollup; a window is emitted once the watermark passed it."""
    return metrics.rollup(rows.withWatermark(ts, delay), width, keys, ts)


def alarms(
    rows: DataFrame, signal: Column, width: str = "5 minutes", threshold: int = 1,
    ts: str = "ts", delay: str = "10 minutes",
) -> DataFrame:
    """Closed windows whose signal reaches the threshold."""
    return metrics.alarms(rows.withWatermark(ts, delay), signal, width, threshold, ts=ts)


def append_parquet(
    rows: DataFrame, path: str, checkpoint: str, buffer_seconds: int | None = None
) -> StreamingQuery:
    """Append finished rows to Parquet; state, if any, is kept on disk."""
    use_disk_backed_state(rows.sparkSession)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, buffer_seconds)


def _merge_batch(
    path: str, keys: Sequence[str], order_by: str, partition_by: str | None, stream: str, keep_versions: int
) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, f"{path}/_batches/{stream}-{batch_id:010d}"
        if files.exists(spark, done):
            return
        # The merge reads the batch more than once, for its keys and for its rows.
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if partition_by is not None:
                mart.upsert_partitions(spark, rows, path, keys, partition_by, order_by)
            else:
                seen = next(lake.versions(spark, path), 0)
                current = lake.read_version(spark, path, seen) if seen else rows.limit(0)
                lake.write_version(upsert_latest(current, rows, keys, order_by), path, based_on=seen)
                lake.drop_old_versions(spark, path, keep_versions)
            files.create(spark, done, "done")
        finally:
            rows.unpersist()

    return merge


def upsert_into(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    order_by: str,
    checkpoint: str,
    buffer_seconds: int | None = None,
    partition_by: str | None = None,
    keep_versions: int = 3,
) -> StreamingQuery:
    """Upsert each micro-batch into the table at ``path``; a row never replaces a newer one.

    With ``partition_by``, a column of the key, only the partitions that a batch names
    are read and replaced.  Without it the table is versioned and rewritten by every
    batch, and all but the newest versions go.  A note is left for every batch that was
    applied, so one that is delivered again is skipped; one that failed half way is
    merged again, with the same result for rows that have a key.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    merge = _merge_batch(path, keys, order_by, partition_by, stream, keep_versions)
    return _start(rows.writeStream.foreachBatch(merge), checkpoint, buffer_seconds)


LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_routed(
    spark: SparkSession,
    landing: str,
    bronze_path: str,
    checkpoint: str,
    schemas: Mapping[str, T.StructType] = RAW_DATASETS,
    ingested_at: Column | None = None,
    max_files: int = 1000,
    buffer_seconds: int | None = None,
) -> StreamingQuery:
    """New CSV files of any dataset to their Bronze tables, each file once.

    One stream lists arriving files (names, times and sizes; contents are not read by
    it).  A micro-batch is routed by dataset and scanned by header group as a batch
    ingest does it, under the same ingest log: a batch delivered again finds its files
    there.
    """
    rows = read_files(
        spark, landing, T.StructType.fromDDL(LISTING), "binaryFile",
        recursiveFileLookup=True, pathGlobFilter="*.csv", maxFilesPerTrigger=max_files,
    )
    listed = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def ingest(batch: DataFrame, batch_id: int) -> None:
        bronze.ingest_listed(batch.sparkSession, csv.route(batch, list(schemas)), bronze_path, schemas, ingested_at)

    return _start(listed.writeStream.foreachBatch(ingest), checkpoint, buffer_seconds)
