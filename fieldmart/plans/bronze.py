"""Raw CSV to Bronze: typed scan plus ingest metadata, partitioned by day."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.schemas import RAW_ALIASES, RAW_DATASETS, schema_of
from fieldmart.sources import csv, files, ledger
from fieldmart.sources.lake import read_optional, row_count, write_partitioned

#: Name of the ingest log beside the Bronze tables.
LOG = "_ingest_log"
INGESTED = schema_of("dataset string, path string, size bigint, modified timestamp")
#: Partition column that names the commit a row came with.
BATCH = "ingestion_batch"


def with_ingest_metadata(
    df: DataFrame, source: Column | None = None, ingested_at: Column | None = None
) -> DataFrame:
    """Add ingestion_timestamp, ingestion_date and source_path (the file by default)."""
    moment = F.current_timestamp() if ingested_at is None else ingested_at
    return df.withColumns(
        {
            "ingestion_timestamp": moment,
            "ingestion_date": moment.cast("date"),
            "source_path": F.col("_metadata.file_path") if source is None else source,
        }
    )


def datasets(spark: SparkSession, raw: str, exported: Collection[str] = ()) -> dict[str, list[str]]:
    """Dataset name -> its files: names only, as any file listing."""
    found = csv.discover(spark, raw, exported).groupBy("dataset").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {row["dataset"]: row["paths"] for row in found.orderBy("dataset").collect()}


def scan_dataset(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | None, aliases: Mapping[str, str] = RAW_ALIASES
) -> DataFrame:
    """All files of one dataset, with ``source_path``."""
    if schema is not None:
        return csv.read_by_header(spark, paths, schema, aliases)
    frame = csv.read(spark, [files.literal_path(p) for p in paths])
    return frame.withColumn("source_path", F.col("_metadata.file_path"))


def ingest(
    spark: SparkSession,
    raw: str,
    bronze: str,
    schemas: Mapping[str, T.StructType] = RAW_DATASETS,
    ingested_at: Column | None = None,
    exported: Collection[str] | None = None,
) -> dict[str, int]:
    """Write every dataset under ``raw`` to its own Bronze folder; rows per dataset.

    Files of one stem in several folders form one dataset, so none overwrites
    another, and so do a plain file and the parts of an export folder of that name.
    ``exported`` names the datasets that may come as folders of parts; all known ones
    by default.  Datasets without a known schema are read with inferred types.
    """
    rows = {}
    for dataset, paths in datasets(spark, raw, list(schemas) if exported is None else exported).items():
        frame = scan_dataset(spark, paths, schemas.get(dataset))
        frame = with_ingest_metadata(frame, F.col("source_path"), ingested_at)
        # All rows belong to today's partition, so each task writes its own file.
        written = write_partitioned(
            frame, f"{bronze}/{dataset}", ["ingestion_date"], measures=[row_count()], gather=False, keep_schema=dataset in schemas
        )
        rows[dataset] = written["rows"]
    return rows


def new_files(spark: SparkSession, listed: DataFrame, bronze: str) -> DataFrame:
    """Files of a listing that the ingest log does not have in this size and of this time."""
    known = ledger.read(spark, f"{bronze}/{LOG}", INGESTED).select("path", "size", "modified")
    return listed.join(known, ["path", "size", "modified"], "left_anti")


def ingest_new(
    spark: SparkSession,
    raw: str,
    bronze: str,
    schemas: Mapping[str, T.StructType] = RAW_DATASETS,
    ingested_at: Column | None = None,
    exported: Collection[str] | None = None,
) -> dict[str, int]:
    """Add the files under ``raw`` that came or changed since the last commit; rows per dataset.

    N runs over files that come one after the other hold the same rows as one run over
    all of them.  A file whose size or time changed counts as a new delivery.
    """
    exported = list(schemas) if exported is None else exported
    return ingest_listed(spark, csv.discover(spark, raw, exported), bronze, schemas, ingested_at)


def ingest_listed(
    spark: SparkSession,
    listed: DataFrame,
    bronze: str,
    schemas: Mapping[str, T.StructType] = RAW_DATASETS,
    ingested_at: Column | None = None,
) -> dict[str, int]:
    """Add the new ones of the listed files (dataset, path, size, modified); rows per dataset.

    Rows go to a folder of this run first; they count once the run's files are in the
    log.  Of two runs that took the same file only one is committed, and the other
    raises ``ledger.Conflict`` after it removed what it wrote.
    """
    # One row per file that came since the last run.
    fresh = new_files(spark, listed, bronze).orderBy("dataset", "path").collect()
    if not fresh:
        return {}
    entry = f"b{uuid.uuid4().hex}"  # a letter first, or a folder name might be read as a number
    by_dataset: dict[str, list[str]] = {}
    for row in fresh:
        by_dataset.setdefault(row["dataset"], []).append(row["path"])
    rows, folders = {}, []
    try:
        for dataset, paths in by_dataset.items():
            frame = with_ingest_metadata(scan_dataset(spark, paths, schemas.get(dataset)), F.col("source_path"), ingested_at)
            folders.append(f"{bronze}/{dataset}")
            written = write_partitioned(
                frame.withColumn(BATCH, F.lit(entry)), folders[-1], ["ingestion_date", BATCH], measures=[row_count()],
                gather=False, keep_schema=dataset in schemas,
            )
            rows[dataset] = written["rows"]

        def check(last: int) -> None:
            later = ledger.read(spark, f"{bronze}/{LOG}", INGESTED, last)
            same = later.join(taken, ["path", "size", "modified"], "left_semi").count()
            if same:
                raise ledger.Conflict(f"{same} of the files were ingested by another run meanwhile")

        taken = spark.createDataFrame([tuple(row[c] for c in INGESTED.fieldNames()) for row in fresh], INGESTED)
        ledger.append(taken, f"{bronze}/{LOG}", entry, check)
    except Exception:
        for folder in folders:
            for day in files.subfolders(spark, folder):
                files.delete(spark, f"{folder}/{day}/{BATCH}={entry}")
        raise
    return rows


def read_bronze(spark: SparkSession, bronze: str, dataset: str) -> DataFrame | None:
    """A Bronze table without rows of runs that never committed, such as ended ones."""
    frame = read_optional(spark, f"{bronze}/{dataset}")
    if frame is None or BATCH not in frame.columns:
        return frame
    return frame.filter(F.col(BATCH).isin(sorted(ledger.entries(spark, f"{bronze}/{LOG}")))).drop(BATCH)


def bronze_days(spark: SparkSession, bronze: str, dataset: str) -> list[str]:
    """Folders of the days that a Bronze table holds: a listing, no data."""
    return [name for name in files.subfolders(spark, f"{bronze}/{dataset}") if name.startswith("ingestion_date=")]
