"""External, partitioned and bucketed catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.sources.lake import NULL_PARTITION


def create_database(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")


def register_external(
    spark: SparkSession, table: str, schema: T.StructType, partition_by: Sequence[str], location: str
) -> DataFrame:
    """Create an external Parquet table over ``location`` and load its partitions."""
    fields = [f for f in schema.fields if f.name not in partition_by]
    fields += [schema[name] for name in partition_by]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(partition_by)}) LOCATION '{location}'"
    )
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def newest_partition(spark: SparkSession, table: str, column: str) -> str | None:
    """The greatest value of a partition column, from the catalog: no file is opened."""
    value = F.regexp_extract("partition", rf"(?:^|/){column}=([^/]*)", 1)
    named = spark.sql(f"SHOW PARTITIONS {table}").select(value.alias("value")).filter(F.col("value") != NULL_PARTITION)
    return named.agg(F.max("value")).first()[0]


def add_new_columns(spark: SparkSession, table: str, observed: T.StructType) -> list[str]:
    """Add columns the files gained since the table was created; nothing is dropped."""
    known = set(spark.table(table).columns)
    new = [f for f in observed.fields if f.name not in known]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    return [f.name for f in new]


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of different ages under one, merged schema."""
    return spark.read.option("mergeSchema", True).parquet(path)


def save_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    bucket_by: str,
    sort_by: Sequence[str],
    buckets: int,
    spread_by: Sequence[str],
    spread: int = 8,
) -> DataFrame:
    """Distribute rows by ``bucket_by`` and sort each bucket file.

    Tasks are cut finer than buckets: the rows of one key go to up to ``spread``
    tasks by a hash of ``spread_by``, each writing its own file of the bucket, so a
    hot key is not written by a single task.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(spread))
    (
        df.repartition(F.col(bucket_by), salt)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, bucket_by)
        .sortBy(*sort_by)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)
