"""Bronze to Silver: types, flags, enrichment, deduplication and rule suites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.functions import classify
from fieldmart.operators import dq
from fieldmart.operators.shaping import typed, with_default
from fieldmart.operators.windows import keep_latest
from fieldmart.plans.bronze import bronze_days, read_bronze
from fieldmart.sources import files
from fieldmart.sources.lake import NULL_PARTITION, in_partitions, location, read_optional, row_count, write_partitioned
from fieldmart.sources.staging import staged

# One row per entity and period, so that lags and rolling means have a history.
RETAILER_KEYS = ("retailer_id", "week")
DISTRICT_KEYS = ("district", "date")
DEMAND_KEYS = ("sku_id", "retailer_id", "week")


def type_retailers(df: DataFrame) -> DataFrame:
    """Typed measures, stockout_risk_flag and revenue_tier."""
    df = typed(
        df,
        {
            "avg_weekly_revenue": "double",
            "days_since_last_visit": "int",
            "stockout_events": "int",
            "avg_depletion_rate": "double",
            "weeks_of_stock": "double",
        },
        {"weeks_of_stock": ["weeks_of_stock_remaining"]},
    )
    return df.withColumns(
        {t.name: t.column() for t in (classify.STOCKOUT_RISK, classify.REVENUE_TIER)}
    )


def type_districts(df: DataFrame) -> DataFrame:
    """Typed weather and pest measures, drought and humidity flags."""
    df = typed(
        df,
        {
            "precip_mm_7d": "double",
            "avg_humidity_pct": "double",
            "total_pest_alerts": "int",
            "high_incidence_count": "int",
            "fungicide_risk_flag": "int",
        },
        {"precip_mm_7d": ["recent_precip_sum"], "avg_humidity_pct": ["recent_humidity_avg"]},
    )
    return df.withColumns(
        {t.name: t.column() for t in (classify.DROUGHT_STRESS, classify.HIGH_HUMIDITY)}
    )


def type_demand(df: DataFrame) -> DataFrame:
    """actual_qty from the raw quantity and week from the week's end date."""
    if "sku_qty" in df.columns:
        df = typed(df, {"actual_qty": "double"}, {"actual_qty": ["sku_qty"]})
    if "week_end_date" in df.columns:
        df = df.withColumn("week", F.col("week_end_date"))
    return df


def enrich_inventory(inventory: DataFrame, retailers: DataFrame) -> DataFrame:
    """Inner join that adds district and state; unknown retailers drop out.

    The newest row per retailer is the dimension, so an inventory row never
    multiplies.  No broadcast is forced: Spark broadcasts the dimension when its
    measured size is below the threshold and splits hot retailers otherwise.
    """
    columns = [c for c in ("retailer_id", "district", "state", "week", "ingestion_timestamp") if c in retailers.columns]
    # Rows of one delivery share a timestamp, so the newest week decides among them.
    order = [c for c in ("ingestion_timestamp", "week") if c in columns]
    rest = [c for c in ("district", "state") if c in columns]
    dimension = keep_latest(retailers.select(*columns), ["retailer_id"], order[0], [*order[1:], *rest])
    facts = inventory.drop("district", "state")
    return facts.join(dimension.select("retailer_id", "district", "state"), "retailer_id")


def valid_retailers(df: DataFrame) -> DataFrame:
    """Rows with a key and a revenue of at least 0; a NULL revenue drops out."""
    return df.filter(F.col("retailer_id").isNotNull() & (F.col("avg_weekly_revenue") >= 0))


def retailer_rules(df: DataFrame, keys=RETAILER_KEYS) -> list[dq.Rule]:
    return [
        dq.not_null(df, ["retailer_id", "district"]),
        dq.non_negative(df, ["avg_weekly_revenue", "stockout_events"]),
        dq.unique(df, keys),
        dq.min_rows(10),
    ]


def district_rules(df: DataFrame, keys=DISTRICT_KEYS) -> list[dq.Rule]:
    return [
        dq.not_null(df, ["district", "state"]),
        dq.non_negative(df, ["total_pest_alerts", "high_incidence_count"]),
        dq.unique(df, keys),
        dq.min_rows(5),
    ]


def demand_rules(df: DataFrame, keys=("sku_id", "district", "retailer_id", "week")) -> list[dq.Rule]:
    return [dq.not_null(df, ["sku_id", "district", "week"]), dq.unique(df, keys)]


SOURCES = {"retailer": "features_retailers", "district": "features_district_risk", "demand": "retailer_inventory_weekly"}
DEFAULT_KEYS = {"retailer": RETAILER_KEYS, "district": DISTRICT_KEYS, "demand": DEMAND_KEYS}


def refine(
    spark: SparkSession,
    bronze: str,
    silver: str,
    reports: str,
    run_time: Column | None = None,
    keys: Mapping[str, Sequence[str]] = DEFAULT_KEYS,
    max_age_hours: int | None = None,
    district_master: DataFrame | None = None,
    day: str | None = None,
    publish: bool = False,
) -> dict[str, int]:
    """Build every Silver table whose Bronze input exists; rows written per table.

    Per table: one pass for all rules, on the rows before deduplication, and one
    write whose row count is observed on the way.  ``max_age_hours`` adds the
    freshness rule, ``district_master`` the referential one.

    With ``day`` only that day's Bronze rows are read, checked and merged into the
    existing tables.  The retailer master is still looked up in all of Bronze, and the
    stored keys are scanned, so those two reads grow with history.

    With ``publish`` a rebuilt table is a new version, and readers have a full table
    throughout.
    """
    retailers = read_bronze(spark, bronze, "features_retailers")
    districts = read_bronze(spark, bronze, "features_district_risk")
    inventory = read_bronze(spark, bronze, "retailer_inventory_weekly")

    def arrived(df: DataFrame) -> DataFrame:
        return df if day is None else df.filter(F.col("ingestion_date") == F.lit(day).cast("date"))

    inputs = {}
    if retailers is not None:
        inputs["retailer"] = (type_retailers(arrived(retailers)), retailer_rules)
    if districts is not None:
        inputs["district"] = (type_districts(arrived(districts)), district_rules)
    if retailers is not None and inventory is not None:
        inputs["demand"] = (type_demand(enrich_inventory(arrived(inventory), retailers)), demand_rules)

    rows = {}
    for table, (frame, suite) in inputs.items():
        own_keys = tuple(keys[table]) != DEFAULT_KEYS[table]
        rules = suite(frame, keys[table]) if own_keys else suite(frame)
        if max_age_hours is not None:
            rules.append(dq.freshness("ingestion_timestamp", max_age_hours, run_time))
        checks = dq.checked(frame, rules)
        if district_master is not None:
            checks = dq.with_results(checks, dq.referential(frame, ["district"], district_master))
        document = dq.report(checks, table, run_time)
        document.coalesce(1).write.mode("append").partitionBy("table").json(reports)

        frame = with_default(frame, "ingestion_date", F.current_date())
        if day is None:
            clean = keep_latest(frame, keys[table])
            # Rows of one day all go to one folder, to which each task adds a file.
            several = len(bronze_days(spark, bronze, SOURCES[table])) > 1
            written = write_partitioned(
                clean, f"{silver}/{table}", ["ingestion_date"], "publish" if publish else "all", [row_count()], gather=several
            )
        else:
            written = merge_newest(spark, frame, f"{silver}/{table}", keys[table])
        rows[table] = written["rows"]
    return rows


def merge_newest(
    spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str], partition_by: str = "ingestion_date"
) -> dict[str, int]:
    """Merge ``rows`` into a deduplicated table, keeping the newest row per key.

    The stored keys, a narrow scan, tell which partitions hold a row that arrives
    again; only those and the arriving ones are read and replaced.  A partition left
    without rows is removed last, so repeating the merge after a failure completes it.
    """
    path = location(spark, path)
    stored = read_optional(spark, path)
    if stored is None:
        return write_partitioned(keep_latest(rows, keys), path, [partition_by], measures=[row_count()])
    arriving = rows.select([F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same_key = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    again = stored.select(*keys, partition_by).join(arriving, same_key, "left_semi").select(partition_by)
    # One value per partition folder: at most the number of days kept.
    days = [row[0] for row in again.union(rows.select(partition_by)).distinct().collect()]
    affected = stored.filter(in_partitions(partition_by, days))
    newest = keep_latest(affected.unionByName(rows, allowMissingColumns=True), keys)
    with staged(newest, "merge") as merged:
        written = write_partitioned(merged, path, [partition_by], measures=[row_count()])
        left = {row[0] for row in merged.select(partition_by).distinct().collect()}
    for day in set(days) - left:
        # Rows without a day stand in the folder that Spark names for NULL.
        files.delete(spark, f"{path}/{partition_by}={NULL_PARTITION if day is None else day}")
    return written
