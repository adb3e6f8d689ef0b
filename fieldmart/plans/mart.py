"""Warehouse mart: typed fact loads, rejects, district dimension, upsert, run log."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart import schemas
from fieldmart.operators.keys import dense_key, stable_key
from fieldmart.operators.shaping import misfits, narrow
from fieldmart.operators.upsert import upsert, upsert_latest
from fieldmart.sources import files, lake
from fieldmart.sources.staging import staged


def to_fact(gold: DataFrame, table: str, loaded_at: Column | None = None) -> DataFrame:
    """Narrow a Gold table to the types of its fact and stamp the load time."""
    facts = narrow(gold, schemas.FACT_TABLES[table])
    return facts.withColumn("loaded_at", F.current_timestamp() if loaded_at is None else loaded_at)


def partition_of(gold: DataFrame, day) -> DataFrame:
    """One day of a Gold table; only that day's folders are read."""
    return gold.filter(F.col("ingestion_date") == F.lit(str(day)).cast("date"))


def _violation(df: DataFrame, table: str) -> Column:
    """Names of the constraints a row breaks, as an array."""
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in schemas.FACT_NOT_NULL[table] if c in df.columns
    ]
    long = [
        F.when(F.length(c) > size, F.lit(f"{c} is longer than {size}"))
        for c, size in schemas.FACT_MAX_LENGTH[table].items()
        if c in df.columns
    ]
    return F.array_compact(F.array(*missing, *long))


def rejects(df: DataFrame, table: str) -> DataFrame:
    """Rows the fact table may not hold, with the reasons."""
    return df.withColumn("reasons", _violation(df, table)).filter(F.size("reasons") > 0)


def accepted(df: DataFrame, table: str) -> DataFrame:
    """Rows that keep every constraint of the fact table."""
    required = [F.col(c).isNull() for c in schemas.FACT_NOT_NULL[table] if c in df.columns]
    long = [F.length(c) > n for c, n in schemas.FACT_MAX_LENGTH[table].items() if c in df.columns]
    return df.filter(~F.coalesce(reduce(or_, required + long), F.lit(False)))


def checked_fact(gold: DataFrame, table: str, loaded_at: Column | None = None) -> DataFrame:
    """All rows of a Gold table narrowed to its fact, with ``reasons``: empty where a row may be loaded.

    A row is turned away for a value that its column has no room for, for a missing
    value where one is required and for a text longer than its column.
    """
    spec = schemas.FACT_TABLES[table]
    marked = gold.withColumn("_misfits", misfits(gold, spec))
    # The marks pass through unchanged.
    facts = narrow(marked, [*spec, ("_misfits", dict(marked.dtypes)["_misfits"], None)])
    # A default must not stand in for a value that was turned away.
    kept = {n: F.when(~F.array_contains(F.col("_misfits.name"), n), F.col(n)) for n, _, default in spec if default is not None}
    facts = facts.withColumns({**kept, "loaded_at": F.current_timestamp() if loaded_at is None else loaded_at})
    return facts.withColumn("reasons", F.concat(F.col("_misfits.reason"), _violation(facts, table))).drop("_misfits")


def load_fact(
    spark: SparkSession, gold: DataFrame, table: str, path: str, loaded_at: Column | None = None,
    partition_by: str = "ingestion_date",
) -> dict[str, int]:
    """Load a Gold table into its fact at ``path/table`` and ``path/rejects/table``; rows of both and read.

    The input is worked out once, into a staged frame both writes read.  Rejects keep
    the fact's columns, the values as text in the reasons.  Days are replaced in both
    places, so a load made again leaves the same rows, and a day without rejects any
    more keeps none.
    """
    read = Observation()
    checked = checked_fact(gold, table, loaded_at).observe(read, lake.row_count())
    with staged(checked, f"load-{table}") as rows:
        good = rows.filter(F.size("reasons") == 0).drop("reasons")
        bad = rows.filter(F.size("reasons") > 0)
        loaded = lake.write_partitioned(good, f"{path}/{table}", [partition_by], measures=[lake.row_count()])
        rejected = lake.write_partitioned(bad, f"{path}/rejects/{table}", [partition_by], measures=[lake.row_count()])
        # One value per day of the load.
        days = {row[0] for row in rows.select(partition_by).distinct().collect()}
        for kind, kept in ((table, good), (f"rejects/{table}", bad)):
            there = {row[0] for row in kept.select(partition_by).distinct().collect()}
            for day in days - there:
                files.delete(spark, f"{path}/{kind}/{partition_by}={lake.NULL_PARTITION if day is None else day}")
    return {"read": read.get["rows"], "loaded": loaded["rows"], "rejected": rejected["rows"]}


def maintain_districts(spark: SparkSession, df: DataFrame, path: str, created_at: Column | None = None) -> int:
    """Add the new districts of ``df`` to the versioned dimension at ``path``; the new version.

    Keys and creation times already given stay; a region is taken from the newest load
    that names one.  Of two writers at once one gets VersionConflict, so no key is given twice.
    """
    moment = F.current_timestamp() if created_at is None else created_at
    natural = ["state", "district"]
    seen = next(lake.versions(spark, path), 0)
    known = lake.read_version(spark, path, seen) if seen else None
    region = F.max("region") if "region" in df.columns else F.max(F.lit(None).cast("string"))
    members = df.groupBy(*natural).agg(region.alias("new_region"))
    numbered = stable_key(known, members, natural, "district_id")
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in natural])
    rows = numbered.alias("n").join(members.alias("m"), same("n", "m"), "left")
    if known is None:
        old_region, old_moment = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    else:
        rows = rows.join(known.alias("k"), same("n", "k"), "left")
        old_region, old_moment = F.col("k.region"), F.col("k.created_at")
    return lake.write_version(
        rows.select(
            F.col("n.district_id").cast("int").alias("district_id"), F.col("n.district").alias("district"), F.col("n.state").alias("state"),
            F.coalesce("m.new_region", old_region).alias("region"), F.coalesce(old_moment, moment).alias("created_at"),
        ),
        path,
        based_on=seen,
    )


def district_dimension(df: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Distinct districts with a surrogate key in (state, district) order."""
    moment = F.current_timestamp() if created_at is None else created_at
    region = F.max("region") if "region" in df.columns else F.max(F.lit(None).cast("string"))
    members = df.groupBy("state", "district").agg(region.alias("region"))
    numbered = dense_key(members, ["state", "district"], "district_id")
    return numbered.select(
        F.col("district_id").cast("int").alias("district_id"),
        "district", "state", "region", moment.alias("created_at"),
    )


def apply_upsert(spark: SparkSession, staging: DataFrame, path: str, keys=schemas.UPSERT_KEYS) -> int:
    """Upsert ``staging`` into the versioned table at ``path``; the new version.

    If another writer commits in between, VersionConflict is raised; call again then.
    """
    seen = next(lake.versions(spark, path), 0)
    merged = upsert(lake.read_version(spark, path, seen), staging, keys) if seen else staging
    return lake.write_version(merged, path, based_on=seen)


def upsert_partitions(
    spark: SparkSession, staging: DataFrame, path: str, keys=schemas.UPSERT_KEYS, partition_by: str = "week",
    order_by: str | None = None,
) -> None:
    """Upsert into a table partitioned by a column of the key, touching few folders.

    With ``order_by`` a staged row only replaces one that is not newer than itself.

    A staged key can only match in its own partition, so just the partitions named
    in staging are read, merged and replaced; the rest of the table is never opened.
    The merge is staged before it replaces what it was read from, and repeating it
    after a failure gives the same table.
    """
    if partition_by not in keys:
        raise ValueError(f"{partition_by} is not part of the key {keys}")
    stored = lake.read_optional(spark, path)
    if stored is None:
        first = staging if order_by is None else upsert_latest(staging.limit(0), staging, keys, order_by)
        lake.write_partitioned(first, path, [partition_by])
        return
    # All stored columns survive; the folder names keep the type they were written with.
    columns = [f for f in stored.schema.fields if f.name != partition_by]
    current = spark.read.schema(T.StructType([*columns, staging.schema[partition_by]])).parquet(path)
    # One value per partition folder of the increment: small by construction.
    named = [row[0] for row in staging.select(partition_by).distinct().collect()]
    touched = current.filter(lake.in_partitions(partition_by, named))
    merge = upsert(touched, staging, keys) if order_by is None else upsert_latest(touched, staging, keys, order_by)
    with staged(merge, "upsert") as merged:
        lake.write_partitioned(merged, path, [partition_by])
