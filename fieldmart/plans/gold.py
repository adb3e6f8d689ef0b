"""Silver to Gold: retailer KPI, district risk, demand forecast and anomalies."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmart.functions import classify
from fieldmart.functions.numeric import exact_sum
from fieldmart.operators import scores, windows
from fieldmart.operators.forecast import project_demand
from fieldmart.operators.shaping import project, with_default
from fieldmart.schemas import GOLD_PARTITIONS, GOLD_TABLES
from fieldmart.sources.lake import row_count, write_partitioned


def retailer_kpi(silver: DataFrame, strict: bool = False, stage_cut_offs: bool = False) -> DataFrame:
    """Priority score, revenue change, visit urgency and top-5 flag per retailer-week."""
    return (
        silver.transform(scores.retailer_priority)
        .transform(windows.flag_top5_in_tehsil, stage_cut_offs)
        .transform(windows.week_over_week_revenue)
        .withColumn("visit_urgency", classify.VISIT_URGENCY.column())
        .transform(project, GOLD_TABLES["retailer_kpi"].fieldNames(), strict)
    )


def district_risk(silver: DataFrame, strict: bool = False) -> DataFrame:
    """Risk score, tier, rolling mean, trend and product advice per district-day."""
    return (
        silver.transform(scores.district_risk)
        .withColumn("risk_tier", classify.RISK_TIER.column())
        .transform(windows.rolling_mean_rows)
        .transform(windows.score_trend)
        .withColumn("recommended_product", classify.RECOMMENDED_PRODUCT.column())
        .transform(project, GOLD_TABLES["district_risk"].fieldNames(), strict)
    )


def demand_series(silver: DataFrame) -> DataFrame:
    """Retailer rows summed to one row per SKU, district and week.

    The forecast windows need one row per week.  The first grouping keeps the SKU
    name as a key, so it hash-aggregates in the map tasks and a SKU with a third of
    all rows shuffles as a few rows per task.  The small result is then laid out by
    series, which serves both the second grouping (a SKU that was renamed keeps one
    row, under its greatest name) and the windows that follow.
    """
    keys = ["sku_id", "district", "state", "week"]
    measures = [c for c in ("actual_qty", "current_stock_qty") if c in silver.columns]
    stamps = [c for c in ("ingestion_date", "ingestion_timestamp") if c in silver.columns]
    names = [c for c in ("sku_name",) if c in silver.columns]
    return (
        silver.groupBy(*keys, *names)
        .agg(*[exact_sum(F.col(c)).alias(c) for c in measures], *[F.max(c).alias(c) for c in stamps])
        .repartition("sku_id", "district")
        .groupBy(*keys)
        .agg(
            *[exact_sum(F.col(c)).alias(c) for c in measures],
            *[F.max(c).alias(c) for c in names + stamps],
        )
    )


def demand_forecast(series: DataFrame, strict: bool = False) -> DataFrame:
    """Moving average, slope, four forecasts, category and stockout flag per series-week.

    Without a stock column the stock counts as 0, so every positive forecast is flagged.
    """
    if "current_stock_qty" not in series.columns:
        warnings.warn("no current_stock_qty: every positive forecast is flagged as a stockout", stacklevel=2)
    return (
        series.transform(with_default, "current_stock_qty", F.lit(0.0))
        .transform(windows.moving_average)
        .transform(windows.trend_slope)
        .transform(project_demand)
        .withColumn("demand_category", classify.DEMAND_CATEGORY.column())
        .withColumn("stockout_risk_flag", classify.SKU_STOCKOUT.column())
        .transform(project, GOLD_TABLES["demand_forecast"].fieldNames(), strict)
    )


def anomalies(forecast: DataFrame, min_skus: int = 3) -> DataFrame:
    """Demand spikes, and district-weeks with at least ``min_skus`` SKUs at stockout risk."""
    spikes = forecast.filter("demand_category = 'SPIKE'").select(
        F.lit("demand_spike").alias("kind"), "district", "week", "sku_id", F.lit(1).cast("bigint").alias("sku_count")
    )
    clusters = (
        forecast.filter("stockout_risk_flag = 1")
        .groupBy("district", "week")
        .agg(F.count(F.lit(1)).alias("sku_count"))
        .filter(F.col("sku_count") >= min_skus)
        .select(
            F.lit("stockout_cluster").alias("kind"),
            "district",
            "week",
            F.lit(None).cast("string").alias("sku_id"),
            "sku_count",
        )
    )
    return spikes.unionByName(clusters)


def summary_columns(table: str) -> list[Column]:
    """Row count and the headline counts of a Gold table, as aggregates."""
    headline = {
        "retailer_kpi": {"urgent": "visit_urgency = 'URGENT'"},
        "district_risk": {"high_risk": "risk_tier = 'HIGH'"},
        "demand_forecast": {"spikes": "demand_category = 'SPIKE'", "stockout": "stockout_risk_flag = 1"},
    }[table]
    counts = [F.count_if(F.expr(test)).alias(name) for name, test in headline.items()]
    return [row_count(), *counts]


def write_gold(df: DataFrame, table: str, path: str, publish: bool = False) -> dict[str, int]:
    """Write a Gold table by state and day; its summary comes from the same job."""
    return write_partitioned(df, path, GOLD_PARTITIONS, "publish" if publish else "all", summary_columns(table))
