"""Business queries over the Gold tables.

``as_of`` is a date literal (text or ``datetime.date``), so the filter on the
partition column prunes folders before anything is read.  Every top-k has a unique
tie-break and runs as a distributed take-ordered, not as a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmart.functions.numeric import exact_avg, exact_sum
from fieldmart.sources.lake import latest_partition


def _on(df: DataFrame, as_of) -> DataFrame:
    """Rows of one day; the newest day when ``as_of`` is None."""
    if as_of is None:
        return latest_partition(df)
    return df.filter(F.col("ingestion_date") == F.lit(str(as_of)).cast("date"))


def _since(df: DataFrame, as_of, days: int) -> DataFrame:
    """Rows of the ``days`` days before ``as_of`` and later; the newest day when None."""
    if as_of is None:
        newest = df.agg(F.max("ingestion_date").alias("newest")).scalar()
    else:
        newest = F.lit(str(as_of)).cast("date")
    return df.filter(F.col("ingestion_date") >= F.date_sub(newest, days))


def urgent_retailers(kpi: DataFrame, as_of=None, limit: int = 10) -> DataFrame:
    """The day's action list: urgent retailers by priority."""
    return (
        _on(kpi, as_of)
        .filter("visit_urgency = 'URGENT'")
        .select(
            "retailer_id", "retailer_name", "state", "district", "tehsil", "week", "rps_score",
            "visit_urgency", "revenue_tier", "stockout_risk_flag",
            F.round("avg_weekly_revenue", 0).alias("revenue_inr"),
            F.col("revenue_wow_pct").alias("wow_change_pct"),
        )
        .orderBy(F.col("rps_score").desc_nulls_last(), "retailer_id", "week")
        .limit(limit)
        .drop("week")
    )


def district_heatmap(risk: DataFrame, as_of=None) -> DataFrame:
    """Districts at medium or high risk on the day, worst first."""
    return (
        _on(risk, as_of)
        .filter(F.col("risk_tier").isin("HIGH", "MEDIUM"))
        .orderBy(F.col("drs_score").desc(), "state", "district")
        .select(
            "state", "district",
            F.round("drs_score", 3).alias("drs_score"),
            F.round("drs_7d_avg", 3).alias("rolling_7d_avg"),
            "drs_trend", "risk_tier", "total_pest_alerts", "high_incidence_count", "recommended_product",
        )
    )


def revenue_trend(kpi: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Revenue, scores and risk counts per state and week over the last days."""
    return (
        _since(kpi, as_of, days)
        .groupBy("state", "week")
        .agg(
            F.count_distinct("retailer_id").alias("active_retailers"),
            F.round(exact_sum(F.col("avg_weekly_revenue")), 0).alias("total_revenue_inr"),
            F.round(exact_avg(F.col("rps_score")), 3).alias("avg_rps"),
            F.sum("stockout_risk_flag").alias("stockout_risk_count"),
            F.count_if(F.col("visit_urgency") == "URGENT").alias("urgent_visits"),
        )
        .orderBy("state", "week")
    )


def growing_demand(forecast: DataFrame, as_of=None, limit: int = 20) -> DataFrame:
    """SKUs with growing demand by total forecast over four weeks."""
    steps = [F.col(f"forecasted_qty_w{n}") for n in range(1, 5)]
    return (
        _on(forecast, as_of)
        .filter(F.col("demand_category").isin("GROWING", "SPIKE"))
        .select(
            "sku_id", "sku_name", "state", "district",
            F.col("ma_4w").alias("baseline_4w_avg"),
            "trend_slope", "demand_category",
            *[f"forecasted_qty_w{n}" for n in range(1, 5)],
            (steps[0] + steps[1] + steps[2] + steps[3]).alias("total_4w_forecast"),
            "stockout_risk_flag",
        )
        .orderBy(F.col("total_4w_forecast").desc(), "sku_id", "state", "district")
        .limit(limit)
        .drop("sku_id")
    )


def daily_health(kpi: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Coverage, risk and score figures per ingestion day, newest first."""
    urgency = F.col("visit_urgency")
    return (
        _since(kpi, as_of, days)
        .groupBy("ingestion_date")
        .agg(
            F.count(F.lit(1)).alias("total_retailer_records"),
            F.count_distinct("retailer_id").alias("unique_retailers"),
            F.count_distinct("district").alias("districts_covered"),
            F.sum("stockout_risk_flag").alias("at_risk_retailers"),
            F.round(exact_avg(F.col("rps_score")), 4).alias("mean_rps"),
            F.round(F.min("rps_score"), 4).alias("min_rps"),
            F.round(F.max("rps_score"), 4).alias("max_rps"),
            F.count_if(urgency == "URGENT").alias("urgent_count"),
            F.count_if(urgency == "SOON").alias("soon_count"),
            F.count_if(urgency == "ROUTINE").alias("routine_count"),
        )
        .orderBy(F.col("ingestion_date").desc())
    )


def cross_layer_priority(kpi: DataFrame, risk: DataFrame, as_of=None, limit: int = 15) -> DataFrame:
    """Retailers in high-risk districts by 0.6 x retailer and 0.4 x district score."""
    districts = (
        _on(risk, as_of)
        .filter("risk_tier = 'HIGH'")
        .select("district", "state", "ingestion_date", "drs_score", "risk_tier", "recommended_product")
    )
    combined = F.round(F.col("rps_score") * 0.6 + F.col("drs_score") * 0.4, 4)
    return (
        _on(kpi, as_of)
        .join(districts, ["district", "state", "ingestion_date"])
        .select(
            "retailer_id", "retailer_name", "state", "district", "week", "rps_score", "visit_urgency",
            "drs_score", F.col("risk_tier").alias("district_risk_tier"), "recommended_product",
            combined.alias("combined_priority_score"),
        )
        .orderBy(F.col("combined_priority_score").desc_nulls_last(), "retailer_id", "week")
        .limit(limit)
        .drop("week")
    )


def district_average_risk(risk: DataFrame, as_of=None) -> DataFrame:
    """Mean risk score per district on the day, highest first."""
    return (
        _on(risk, as_of)
        .groupBy("district")
        .agg(F.round(exact_avg(F.col("drs_score")), 4).alias("avg_risk"))
        .orderBy(F.col("avg_risk").desc(), "district")
    )
