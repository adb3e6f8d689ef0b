"""Helpers on frames that several operators share."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of the fixed-size filter: 512 KB whatever the data.
FILTER_BITS = 22


def input_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is an error that names it."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


def numbered(df: DataFrame, key: str, order: list[Column], name: str, cells: int = 256) -> DataFrame:
    """Number the rows of every key from 0 without gaps, without one task per key.

    Rows of a key are dealt by a hash of ``order`` over ``cells`` parts.  Counts per
    part (one small row each) give the first number of each part; inside a part
    row_number does the rest.  ``df`` is read twice, so stage it first.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    parts = df.withColumn("_cell", cell)
    counts = parts.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col(key).alias("_key"), F.col("_cell").alias("_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    inside = Window.partitionBy(key, "_cell").orderBy(*order)
    ranked = parts.withColumn("_row", F.row_number().over(inside))
    return (
        ranked.join(firsts, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_part")))
        .withColumn(name, (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_cell", "_row", "_key", "_part", "_first")
    )


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with the top bits of every 64-bit hash in ``column``.

    A hash whose bit is unset is certainly absent; one whose bit is set must still
    be joined.  At most 2**FILTER_BITS / 64 rows reach the driver, whatever the input.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    words = (
        hashes.select((place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words:
        bitmap[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return bitmap


def maybe_in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap does not rule out."""
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def release() -> None:
    """Give memory that a Python worker has freed back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another allocator


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a partition's batches, which leaves no freed memory held at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


_shipped: set[str] = set()

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once per application.

    Rows hold whole texts, so a batch of Spark's default of 10,000 rows would be large on
    both sides of the pipe; a session that keeps the default gets smaller ones.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        if package.is_dir():  # else it came in an archive that the workers have as well
            archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='fieldmart-')}/fieldmart", "zip", package.parent, package.name)
            context.addPyFile(archive)
    return spark
