"""Field-sales views derived from the given tables.

The tables hold orders and events, not retailers and districts, so the domain
frames are derived: a customer is a retailer, its market segment the tehsil, its
nation the district, its region the state; a part type is an SKU; events per
nation and day stand for the weather and pest feed.

Facts are aggregated before they meet a dimension where that makes them fewer, so a hot
user shuffles as one row per task.  Where it does not, as with the orders and lines of a
customer, they meet it first: the join's shuffle then serves the grouping as well, and
Spark splits a hot customer on the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.functions.calendar import iso_week
from fieldmart.functions.numeric import scaled

KPI_DAY = "2024-01-30"
DEMAND_DAY = "2001-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region as (n_nationkey, district, state)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("state")
    )


def _retailer_id(key: str) -> Column:
    return F.concat(F.lit("R"), F.col(key).cast("string"))


def _month(column: str) -> Column:
    """First day of the month, as a date: a narrower key than its text."""
    return F.trunc(F.col(column).cast("date"), "month")


def retailer_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and ISO week of its orders.

    The week is its Monday until the rows are shaped, which keeps it narrow in shuffles.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.min("l_quantity").alias("least"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"),
        scaled(F.col("o_totalprice"), 2).alias("cents"), (F.col("o_orderstatus") == "P").alias("out_of_stock"),
    )
    # Joined before it is grouped, one shuffle by customer serves both, and a hot customer
    # is split by the join.  The number keeps customer rows of one key apart.
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.monotonically_increasing_id().alias("row"))
    weekly = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_custkey", F.trunc("day", "week").alias("monday"), *customers.columns[1:])
        .agg(
            F.sum("cents").alias("cents"),
            F.max("day").alias("last_visit"),
            F.count_if("out_of_stock").cast("int").alias("stockout_events"),
            F.sum("quantity").alias("quantity"),
            F.min("least").alias("least"),
        )
    )
    return (
        weekly.join(districts(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _retailer_id("o_custkey").alias("retailer_id"),
            F.col("c_name").alias("retailer_name"),
            "state",
            "district",
            F.col("c_mktsegment").alias("tehsil"),
            iso_week(F.col("monday")).alias("week"),
            (F.col("cents") / 1000).alias("avg_weekly_revenue"),
            F.datediff(F.lit("2001-12-31").cast("date"), "last_visit").alias("days_since_last_visit"),
            "stockout_events",
            (F.col("quantity") / 7).alias("avg_depletion_rate"),
            (F.col("least") / 5).alias("weeks_of_stock"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.weekofyear("monday") % 30).alias("ingestion_date"),
        )
        .withColumn("ingestion_timestamp", F.col("ingestion_date").cast("timestamp"))
    )


def district_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation and day of its users' events."""
    value = F.col("value")
    daily = (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 25).alias("nation_key"), F.col("ts").cast("date").alias("day"))
        .agg(
            F.min(value).alias("least"),
            F.max(value).alias("most"),
            F.count_if(F.col("event_type") == "error").cast("int").alias("total_pest_alerts"),
            F.count_if(value > 60).cast("int").alias("above"),
        )
    )
    return (
        daily.join(districts(spark, sf_dir), F.col("nation_key") == F.col("n_nationkey"))
        .select(
            "district",
            "state",
            F.date_format("day", "yyyy-MM-dd").alias("date"),
            F.col("least").alias("precip_mm_7d"),
            (F.col("most") / 2).alias("avg_humidity_pct"),
            "total_pest_alerts",
            (F.col("above") * 3).alias("high_incidence_count"),
            (F.col("most") > 200).cast("int").alias("fungicide_risk_flag"),
            F.col("day").alias("ingestion_date"),
        )
        .withColumn("ingestion_timestamp", F.col("ingestion_date").cast("timestamp"))
    )


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with retailer, SKU and month."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", _month("l_shipdate").alias("month"),
        F.col("l_quantity").cast("bigint").alias("quantity"), (F.col("l_linestatus") == "O").alias("is_open"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(_retailer_id("o_custkey").alias("retailer_id"), "p_type", "month", "quantity", "is_open")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inventory rows: one per customer, part type and month."""
    return stock_of(sold_lines(spark, sf_dir))


def stock_of(lines: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Lines summed to one row per retailer, SKU and month; ``also`` names further columns of a retailer.

    Lines that were joined by retailer are summed without another shuffle.
    """
    return (
        lines.groupBy("retailer_id", "p_type", "month", *also)
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum(F.when(F.col("is_open"), F.col("quantity")).otherwise(0)).alias("open_quantity"),
        )
        .select(
            "retailer_id",
            F.col("p_type").alias("sku_id"),
            F.concat(F.lit("SKU "), "p_type").alias("sku_name"),
            F.col("quantity").cast("double").alias("sku_qty"),
            (F.col("open_quantity") * 2).cast("double").alias("current_stock_qty"),
            F.date_format("month", "yyyy-MM-dd").alias("week_end_date"),
            *also,
        )
    )


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retailer master: every customer with its district and state."""
    return (
        table(spark, sf_dir, "customer")
        .join(districts(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _retailer_id("c_custkey").alias("retailer_id"),
            F.col("c_name").alias("retailer_name"),
            "district",
            "state",
            F.lit("2024-01-01 00:00:00").alias("ingestion_timestamp"),
        )
    )


def dirty_retailer_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retailer_weeks`` with missing keys, missing and negative revenues."""
    revenue = F.col("avg_weekly_revenue")
    return retailer_weeks(spark, sf_dir).withColumns(
        {
            "retailer_id": F.when(F.col("weeks_of_stock") != 0.2, F.col("retailer_id")),
            "district": F.when(F.col("stockout_events") <= 1, F.col("district")),
            "avg_weekly_revenue": F.when(F.col("days_since_last_visit") < 100, -revenue).when(
                F.col("days_since_last_visit") < 2000, revenue
            ),
        }
    )
