"""Column lists and types of every layer."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def schema_of(columns: str) -> T.StructType:
    """Schema from ``name type, name type`` text; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# Raw CSV datasets, by file stem.
RAW_RETAILERS = schema_of(
    "retailer_id string, retailer_name string, state string, district string, tehsil string, "
    "week string, avg_weekly_revenue double, days_since_last_visit int, stockout_events int, "
    "avg_depletion_rate double, weeks_of_stock double"
)
RAW_DISTRICTS = schema_of(
    "district string, state string, date string, precip_mm_7d double, avg_humidity_pct double, "
    "total_pest_alerts int, high_incidence_count int, fungicide_risk_flag int"
)
RAW_INVENTORY = schema_of(
    "retailer_id string, sku_id string, sku_name string, sku_qty double, week_end_date string, "
    "current_stock_qty double"
)
# Other headers under which sources deliver a column.
RAW_ALIASES = {
    "weeks_of_stock_remaining": "weeks_of_stock",
    "recent_precip_sum": "precip_mm_7d",
    "recent_humidity_avg": "avg_humidity_pct",
}
RAW_DATASETS = {
    "features_retailers": RAW_RETAILERS,
    "features_district_risk": RAW_DISTRICTS,
    "retailer_inventory_weekly": RAW_INVENTORY,
}

GOLD_PARTITIONS = ("state", "ingestion_date")

GOLD_RETAILER_KPI = schema_of(
    "retailer_id string, retailer_name string, state string, district string, tehsil string, "
    "week string, avg_weekly_revenue double, revenue_tier string, revenue_wow_pct double, "
    "rps_score double, stockout_risk_flag int, stockout_events int, weeks_of_stock double, "
    "visit_urgency string, top5_in_tehsil int, ingestion_date date, ingestion_timestamp timestamp"
)
GOLD_DISTRICT_RISK = schema_of(
    "district string, state string, date string, drs_score double, drs_7d_avg double, "
    "drs_trend string, risk_tier string, fungicide_risk_flag int, drought_stress_flag int, "
    "high_humidity_flag int, total_pest_alerts int, high_incidence_count int, "
    "recommended_product string, ingestion_date date, ingestion_timestamp timestamp"
)
GOLD_DEMAND_FORECAST = schema_of(
    "sku_id string, sku_name string, district string, state string, week string, "
    "actual_qty double, current_stock_qty double, ma_4w double, trend_slope double, "
    "demand_category string, stockout_risk_flag int, forecasted_qty_w1 double, "
    "forecasted_qty_w2 double, forecasted_qty_w3 double, forecasted_qty_w4 double, "
    "ingestion_date date, ingestion_timestamp timestamp"
)
GOLD_TABLES = {
    "retailer_kpi": GOLD_RETAILER_KPI,
    "district_risk": GOLD_DISTRICT_RISK,
    "demand_forecast": GOLD_DEMAND_FORECAST,
}

# Mart facts: (column, type, default); a default of None means NULL stays NULL.
FACT_RETAILER_KPI = (
    ("retailer_id", "string", None),
    ("retailer_name", "string", None),
    ("state", "string", None),
    ("district", "string", None),
    ("tehsil", "string", None),
    ("week", "string", None),
    ("avg_weekly_revenue", "decimal(15,2)", None),
    ("revenue_tier", "string", None),
    ("revenue_wow_pct", "decimal(8,2)", None),
    ("rps_score", "decimal(6,4)", None),
    ("stockout_risk_flag", "smallint", 0),
    ("stockout_events", "int", 0),
    ("weeks_of_stock", "decimal(6,2)", None),
    ("visit_urgency", "string", None),
    ("top5_in_tehsil", "smallint", 0),
    ("ingestion_date", "date", None),
    ("ingestion_timestamp", "timestamp", None),
)
FACT_DISTRICT_RISK = (
    ("district", "string", None),
    ("state", "string", None),
    ("date", "date", None),
    ("drs_score", "decimal(6,4)", None),
    ("drs_7d_avg", "decimal(6,4)", None),
    ("drs_trend", "string", None),
    ("risk_tier", "string", None),
    ("fungicide_risk_flag", "smallint", 0),
    ("drought_stress_flag", "smallint", 0),
    ("high_humidity_flag", "smallint", 0),
    ("total_pest_alerts", "int", 0),
    ("high_incidence_count", "int", 0),
    ("recommended_product", "string", None),
    ("ingestion_date", "date", None),
)
FACT_DEMAND_FORECAST = (
    ("sku_id", "string", None),
    ("sku_name", "string", None),
    ("district", "string", None),
    ("state", "string", None),
    ("week", "string", None),
    ("actual_qty", "decimal(12,2)", None),
    ("current_stock_qty", "decimal(12,2)", None),
    ("ma_4w", "decimal(12,2)", None),
    ("trend_slope", "decimal(10,2)", None),
    ("demand_category", "string", None),
    ("stockout_risk_flag", "smallint", 0),
    ("forecasted_qty_w1", "decimal(12,2)", None),
    ("forecasted_qty_w2", "decimal(12,2)", None),
    ("forecasted_qty_w3", "decimal(12,2)", None),
    ("forecasted_qty_w4", "decimal(12,2)", None),
    ("ingestion_date", "date", None),
)
FACT_TABLES = {
    "retailer_kpi": FACT_RETAILER_KPI,
    "district_risk": FACT_DISTRICT_RISK,
    "demand_forecast": FACT_DEMAND_FORECAST,
}
FACT_NOT_NULL = {
    "retailer_kpi": ("retailer_id", "state", "district", "week", "ingestion_date"),
    "district_risk": ("district", "state", "date", "ingestion_date"),
    "demand_forecast": ("sku_id", "district", "state", "week", "ingestion_date"),
}
FACT_MAX_LENGTH = {
    "retailer_kpi": {
        "retailer_id": 50, "retailer_name": 200, "state": 100, "district": 100, "tehsil": 100,
        "week": 10, "revenue_tier": 10, "visit_urgency": 10,
    },
    "district_risk": {
        "district": 100, "state": 100, "drs_trend": 10, "risk_tier": 10, "recommended_product": 100,
    },
    "demand_forecast": {
        "sku_id": 50, "sku_name": 200, "district": 100, "state": 100, "week": 10, "demand_category": 20,
    },
}
# Mart layout: rows of a district lie together, sorted by these columns.
FACT_SORT_KEYS = {
    "retailer_kpi": ("ingestion_date", "state", "district"),
    "district_risk": ("date", "state"),
    "demand_forecast": ("ingestion_date", "sku_id"),
}
UPSERT_KEYS = ("retailer_id", "week")

RUN_LOG = schema_of(
    "run_id string, execution_arn string, pipeline_name string, start_time timestamp, "
    "end_time timestamp, status string, rows_bronze bigint, rows_silver bigint, rows_gold bigint, "
    "dq_failures int, triggered_by string, created_at timestamp"
)
