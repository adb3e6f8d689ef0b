"""Registered queries: ``name -> callable(spark, sf_dir) -> DataFrame``.

Dates, timestamps and decimals leave as text, so results compare the same way in
any engine.
"""

from __future__ import annotations

import uuid
from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart import schemas
from fieldmart.catalogue import layers, views
from fieldmart.catalogue.views import DEMAND_DAY, KPI_DAY
from fieldmart.functions import classify
from fieldmart.operators import dq, metrics, scores, windows
from fieldmart.operators.forecast import project_demand
from fieldmart.operators.upsert import delete_matched
from fieldmart.plans import bronze, gold, mart, medallion, partial_gold, reports, silver
from fieldmart.session import configure
from fieldmart.sources import catalog, csv, lake
from fieldmart.sources.staging import fresh_path, stage
from fieldmart.streaming import jobs, late

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}
LOAD_TIME = "2024-01-31 02:00:00"


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text; all else unchanged."""
    out = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DateType, T.DecimalType)):
            value = value.cast("string")
        out.append(value.alias(field.name))
    return df.select(out)


def query(function: Query) -> Query:
    """Register under the function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(function(configure(spark), sf_dir))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    _REGISTRY[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _moment(text: str):
    return F.lit(text).cast("timestamp")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant instead of a zoneless time."""
    events = views.table(spark, sf_dir, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _raw_csv(df: DataFrame, path: str, dataset: str) -> str:
    """Export ``df`` as CSV part files of a dataset folder under ``path``."""
    df.write.mode("append").option("header", True).csv(f"{path}/{dataset}")
    return path


# --- Bronze and Silver -----------------------------------------------------------


@query
def bronze_metadata(spark, sf_dir):
    """Ingest metadata on a scanned table."""
    orders = views.table(spark, sf_dir, "orders")
    return bronze.with_ingest_metadata(orders, None, _moment(LOAD_TIME)).select(
        "o_orderkey", "ingestion_timestamp", "ingestion_date",
        F.regexp_extract("source_path", r"([^/]+\.parquet)", 1).alias("source_file"),
    )


@query
def bronze_csv_roundtrip(spark, sf_dir):
    """CSV export -> discovery -> typed scan -> Bronze Parquet -> read back."""
    raw, target = fresh_path(spark, "raw"), fresh_path(spark, "bronze")
    columns = schemas.RAW_RETAILERS.fieldNames()
    _raw_csv(views.retailer_weeks(spark, sf_dir).select(columns), raw, "features_retailers")
    bronze.ingest(spark, raw, target, ingested_at=_moment(LOAD_TIME))
    return spark.read.parquet(f"{target}/features_retailers").select(
        *columns, "ingestion_date", F.col(csv.CORRUPT_RECORD).isNotNull().alias("corrupt")
    )


def _csv_with_header(rows: DataFrame, path: str, header: list[str]) -> None:
    """CSV parts whose header row is ``header``, which may hold names a frame cannot have."""
    columns = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)]
    part = F.spark_partition_id()
    lines = rows.select(part.alias("part"), F.lit(1).alias("place"), F.to_csv(F.struct(*columns)).alias("line"))
    heads = lines.select("part").distinct().select("part", F.lit(0).alias("place"), F.lit(",".join(header)).alias("line"))
    both = lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "place")
    both.select("part", "line").write.partitionBy("part").text(path)


@query
def bronze_csv_headers(spark, sf_dir):
    """One dataset whose files have alias, reordered, extra, missing, doubled, padded and upper-case headers."""
    target = fresh_path(spark, "bronze")
    rows = stage(views.retailer_weeks(spark, sf_dir).withColumn("note", F.concat(F.lit("n"), "stockout_events")), "weeks")
    files_ = {
        "one": (rows.filter("stockout_events = 0"), "retailer_id retailer_name state district tehsil week avg_weekly_revenue days_since_last_visit stockout_events avg_depletion_rate weeks_of_stock note week",
                "Retailer_ID,retailer_name, state,district ,tehsil,WEEK,avg_weekly_revenue,days_since_last_visit,stockout_events,avg_depletion_rate,weeks_of_stock_remaining,note,Note"),
        "two": (rows.filter("stockout_events > 0"), "note week retailer_id state district weeks_of_stock avg_weekly_revenue tehsil",
                "note,week,retailer_id,State,district,weeks_of_stock,avg_weekly_revenue,tehsil"),
    }
    paths = []
    for name, (part, columns, header) in files_.items():
        path = fresh_path(spark, f"headers-{name}")
        _csv_with_header(part.select(*columns.split()), path, header.split(","))
        paths += [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path").collect()]
    frame = bronze.with_ingest_metadata(bronze.scan_dataset(spark, paths, schemas.RAW_RETAILERS), F.col("source_path"), _moment(LOAD_TIME))
    lake.write_partitioned(frame, target, ["ingestion_date"], gather=False)
    return lake.read_optional(spark, target).select(
        "retailer_id", "retailer_name", "state", "district", "tehsil", "week", "avg_weekly_revenue", "stockout_events", "weeks_of_stock", "note", "Note_12"
    )


@query
def bronze_incremental(spark, sf_dir):
    """Three deliveries, each ingested by a run that reads its new files only; rows per run."""
    raw, target = fresh_path(spark, "raw"), fresh_path(spark, "bronze")
    rows = stage(views.retailer_weeks(spark, sf_dir).select(*schemas.RAW_RETAILERS.fieldNames()), "weeks")
    for k in range(3):
        _raw_csv(rows.filter(F.pmod(F.col("days_since_last_visit"), F.lit(3)) == k), f"{raw}/{k}", "features_retailers")
        bronze.ingest_new(spark, raw, target, ingested_at=_moment(f"2024-02-0{k + 1} 00:00:00"))
    bronze.ingest_new(spark, raw, target, ingested_at=_moment("2024-02-09 00:00:00"))  # finds nothing
    return bronze.read_bronze(spark, target, "features_retailers").select("retailer_id", "week", "avg_weekly_revenue", "ingestion_date")


@query
def schema_merge(spark, sf_dir):
    """Files of two ages read under one schema; the older lacks a column."""
    path = fresh_path(spark, "merged")
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    orders.filter("o_orderdate < '1999-01-01'").drop("o_orderpriority").write.parquet(f"{path}/age=1")
    orders.filter("o_orderdate >= '1999-01-01'").write.parquet(f"{path}/age=2")
    return catalog.read_merged(spark, path).select("o_orderkey", "o_orderpriority", "age")


@query
def silver_retailer(spark, sf_dir):
    """Text input with a raw alias -> typed columns, stock flag and revenue tier."""
    raw = views.retailer_weeks(spark, sf_dir)
    text = raw.select(
        "retailer_id", "week",
        *[F.col(c).cast("string").alias(c) for c in
          ("avg_weekly_revenue", "days_since_last_visit", "stockout_events", "avg_depletion_rate")],
        F.col("weeks_of_stock").cast("string").alias("weeks_of_stock_remaining"),
    )
    return silver.type_retailers(text).drop("weeks_of_stock_remaining")


@query
def silver_district(spark, sf_dir):
    """Raw weather names -> typed columns, drought and humidity flags."""
    raw = views.district_days(spark, sf_dir)
    renamed = raw.withColumnsRenamed({"precip_mm_7d": "recent_precip_sum", "avg_humidity_pct": "recent_humidity_avg"})
    return silver.type_districts(renamed).drop(
        "recent_precip_sum", "recent_humidity_avg", "ingestion_date", "ingestion_timestamp"
    )


@query
def silver_demand(spark, sf_dir):
    """Inventory enriched with district and state, typed, one row per key."""
    frame = silver.type_demand(
        silver.enrich_inventory(views.inventory(spark, sf_dir), views.retailers(spark, sf_dir))
    )
    return windows.keep_latest(frame, silver.DEMAND_KEYS, "week").select(
        "retailer_id", "sku_id", "district", "state", "week", "actual_qty"
    )


@query
def silver_valid_rows(spark, sf_dir):
    """Rows with a key and a non-negative revenue."""
    return silver.valid_retailers(views.dirty_retailer_weeks(spark, sf_dir)).select(
        "retailer_id", "retailer_name", "week", "avg_weekly_revenue"
    )


@query
def enrich_inventory(spark, sf_dir):
    """Inventory x retailer master, adding district and state."""
    return silver.enrich_inventory(views.inventory(spark, sf_dir), views.retailers(spark, sf_dir)).select(
        "retailer_id", "sku_id", "week_end_date", "sku_qty", "district", "state"
    )


@query
def dedup_latest(spark, sf_dir):
    """The newest line per (order, line number)."""
    lines = views.table(spark, sf_dir, "lineitem")
    return windows.keep_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")


@query
def silver_daily_merge(spark, sf_dir):
    """A day that delivers corrected rows again, merged into the stored table by key."""
    path = fresh_path(spark, "silver")
    stored = layers.silver_retailers(spark, sf_dir).select(
        "retailer_id", "week", "avg_weekly_revenue", "ingestion_date", "ingestion_timestamp"
    )
    arriving = stored.filter("ingestion_date >= '2024-01-15'").withColumns(
        {
            "avg_weekly_revenue": F.col("avg_weekly_revenue") + 1000,
            "ingestion_date": F.lit("2024-02-01").cast("date"),
            "ingestion_timestamp": _moment("2024-02-01 02:00:00"),
        }
    )
    silver.merge_newest(spark, stored, path, silver.RETAILER_KEYS)
    silver.merge_newest(spark, arriving, path, silver.RETAILER_KEYS)
    return spark.read.parquet(path).drop("ingestion_timestamp")


# --- Scores and windows ----------------------------------------------------------


@query
def min_max_norm(spark, sf_dir):
    """Four columns scaled to [0, 1]."""
    names = {
        "avg_weekly_revenue": "norm_revenue",
        "days_since_last_visit": "norm_days_since",
        "stockout_events": "norm_stockout_events",
        "avg_depletion_rate": "norm_depletion",
    }
    return scores.min_max_norm(layers.silver_retailers(spark, sf_dir), names).select(
        "retailer_id", "week", *names.values()
    )


@query
def rps_score(spark, sf_dir):
    """Retailer priority score and the urgency it gives."""
    scored = scores.retailer_priority(layers.silver_retailers(spark, sf_dir))
    return scored.select("retailer_id", "week", "rps_score", classify.VISIT_URGENCY.column())


@query
def drs_score(spark, sf_dir):
    """District risk score and tier."""
    scored = scores.district_risk(layers.silver_districts(spark, sf_dir))
    return scored.select("district", "date", "drs_score", classify.RISK_TIER.column())


@query
def wow_revenue(spark, sf_dir):
    """Revenue change against the retailer's previous week."""
    return windows.week_over_week_revenue(layers.silver_retailers(spark, sf_dir)).select(
        "retailer_id", "week", "avg_weekly_revenue", "revenue_wow_pct"
    )


@query
def top5_in_group(spark, sf_dir):
    """Five best scores per tehsil and week, ties included."""
    scored = scores.retailer_priority(layers.silver_retailers(spark, sf_dir))
    return windows.flag_top5_in_tehsil(scored).select("retailer_id", "tehsil", "week", "top5_in_tehsil")


@query
def rolling_7_rows(spark, sf_dir):
    """Mean score of the last seven rows."""
    scored = scores.district_risk(layers.silver_districts(spark, sf_dir))
    return windows.rolling_mean_rows(scored).select("district", "date", "drs_7d_avg")


@query
def rolling_7_days(spark, sf_dir):
    """Mean score of the last seven calendar days."""
    scored = scores.district_risk(layers.silver_districts(spark, sf_dir))
    return windows.rolling_mean_days(scored).select("district", "date", "drs_7d_avg")


@query
def drs_trend(spark, sf_dir):
    """Direction of the score against the previous day."""
    scored = scores.district_risk(layers.silver_districts(spark, sf_dir))
    return windows.score_trend(scored).select("district", "date", "drs_trend")


@query
def moving_avg_4w(spark, sf_dir):
    """Four-row moving average of the demand series."""
    series = gold.demand_series(layers.silver_demand(spark, sf_dir))
    return windows.moving_average(series).select("sku_id", "district", "week", "actual_qty", "ma_4w")


@query
def trend_slope(spark, sf_dir):
    """Average change over four rows of the demand series."""
    series = gold.demand_series(layers.silver_demand(spark, sf_dir))
    return windows.trend_slope(series).select("sku_id", "district", "week", "trend_slope")


@query
def demand_forecast(spark, sf_dir):
    """Four forecasts and the stockout flag where no stock column is known."""
    series = gold.demand_series(layers.silver_demand(spark, sf_dir).drop("current_stock_qty"))
    return gold.demand_forecast(series).select(
        "sku_id", "district", "week", "forecasted_qty_w1", "forecasted_qty_w2", "forecasted_qty_w3",
        "forecasted_qty_w4", "current_stock_qty", "stockout_risk_flag",
    )


@query
def recommend_product(spark, sf_dir):
    """Product advice from ordered rules."""
    return layers.silver_districts(spark, sf_dir).select(
        "district", "date", classify.RECOMMENDED_PRODUCT.column()
    )


# --- Gold ------------------------------------------------------------------------


@query
def gold_retailer_kpi(spark, sf_dir):
    return layers.computed_gold(spark, sf_dir, "retailer_kpi")


@query
def gold_district_risk(spark, sf_dir):
    return layers.computed_gold(spark, sf_dir, "district_risk")


@query
def gold_demand_forecast(spark, sf_dir):
    return layers.computed_gold(spark, sf_dir, "demand_forecast")


def _two_refreshes(spark, rows: DataFrame, late, table: partial_gold.Table, keys) -> DataFrame:
    """Gold after all but the ``late`` rows, brought up to date once these are merged into Silver."""
    path, target, state = (fresh_path(spark, name) for name in ("silver", "gold", "gold-state"))
    for part in (rows.filter(~late), rows.filter(late)):
        silver.merge_newest(spark, part, path, keys)
        partial_gold.refresh(spark, table, path, target, state)
    return lake.read_optional(spark, target)


@query
def gold_retailer_partial(spark, sf_dir):
    """Retailer KPI rebuilt once, then brought up to date with a late day."""
    rows = layers.silver_retailers(spark, sf_dir)
    late = F.col("ingestion_date") == F.lit("2024-01-20").cast("date")
    return _two_refreshes(spark, rows, late, partial_gold.RETAILER_KPI, silver.RETAILER_KEYS)


@query
def gold_district_partial(spark, sf_dir):
    """District risk rebuilt once, then brought up to date with a late day in mid-calendar."""
    rows = layers.silver_districts(spark, sf_dir)
    late = F.col("ingestion_date") == F.lit("2024-01-20").cast("date")
    return _two_refreshes(spark, rows, late, partial_gold.DISTRICT_RISK, silver.DISTRICT_KEYS)


@query
def gold_published(spark, sf_dir):
    """Two published rebuilds of the retailer KPI, the first without a day; the newest version is read."""
    path, rows = fresh_path(spark, "published"), layers.silver_retailers(spark, sf_dir)
    for part in (rows.filter("ingestion_date != '2024-01-20'"), rows):
        gold.write_gold(gold.retailer_kpi(part, stage_cut_offs=True), "retailer_kpi", path, publish=True)
    return lake.read_optional(spark, path)


@query
def gold_anomalies(spark, sf_dir):
    """Demand spikes and stockout clusters."""
    return gold.anomalies(layers.stored_gold(spark, sf_dir, "demand_forecast"))


@query
def gold_summary(spark, sf_dir):
    """Headline counts of the three Gold tables, one pass each."""
    parts = []
    for table in schemas.GOLD_TABLES:
        columns = gold.summary_columns(table)
        counts = layers.stored_gold(spark, sf_dir, table).agg(*columns)
        parts.append(
            counts.unpivot([], counts.columns, "metric", "value").select(
                F.lit(table).alias("table_name"), "metric", "value"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def gold_partition_counts(spark, sf_dir):
    """Rows per written (state, day) partition."""
    kpi = layers.stored_gold(spark, sf_dir, "retailer_kpi")
    return kpi.groupBy("state", "ingestion_date").agg(F.count(F.lit(1)).alias("rows"))


# --- Business queries --------------------------------------------------------------


@query
def q1_urgent_retailers(spark, sf_dir):
    return reports.urgent_retailers(layers.stored_gold(spark, sf_dir, "retailer_kpi"), KPI_DAY)


@query
def q2_district_heatmap(spark, sf_dir):
    return reports.district_heatmap(layers.stored_gold(spark, sf_dir, "district_risk"), KPI_DAY)


@query
def q3_revenue_trend(spark, sf_dir):
    return reports.revenue_trend(layers.stored_gold(spark, sf_dir, "retailer_kpi"), KPI_DAY)


@query
def q4_growing_demand(spark, sf_dir):
    return reports.growing_demand(layers.stored_gold(spark, sf_dir, "demand_forecast"), DEMAND_DAY)


@query
def q5_daily_health(spark, sf_dir):
    return reports.daily_health(layers.stored_gold(spark, sf_dir, "retailer_kpi"), KPI_DAY)


@query
def q6_cross_layer_priority(spark, sf_dir):
    return reports.cross_layer_priority(
        layers.stored_gold(spark, sf_dir, "retailer_kpi"),
        layers.stored_gold(spark, sf_dir, "district_risk"),
        KPI_DAY,
    )


@query
def district_avg_risk(spark, sf_dir):
    """Mean risk per district on the newest day."""
    newest = catalog.newest_partition(spark, layers.gold_table(spark, sf_dir, "district_risk"), "ingestion_date")
    return reports.district_average_risk(layers.stored_gold(spark, sf_dir, "district_risk"), newest)


@query
def catalog_gold_scan(spark, sf_dir):
    """External partitioned table over Gold: create, load partitions, scan one day."""
    name = f"fieldmart_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name, fresh_path(spark, "catalog"))
    table = catalog.register_external(
        spark, f"{name}.gold_retailer_kpi", schemas.GOLD_RETAILER_KPI, schemas.GOLD_PARTITIONS,
        layers.gold_path(spark, sf_dir, "retailer_kpi"),
    )
    return (
        table.filter(F.col("ingestion_date") == F.lit(KPI_DAY).cast("date"))
        .groupBy("state", "visit_urgency")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("rps_score").alias("max_rps"))
    )


# --- Data quality ------------------------------------------------------------------


@query
def dq_not_null(spark, sf_dir):
    frame = views.dirty_retailer_weeks(spark, sf_dir)
    return dq.evaluate(frame, [dq.not_null(frame, ["retailer_id", "district"])])


@query
def dq_non_negative(spark, sf_dir):
    frame = views.table(spark, sf_dir, "customer")
    return dq.evaluate(frame, [dq.non_negative(frame, ["c_acctbal", "c_custkey", "c_credit"])])


@query
def dq_unique(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    documents = views.table(spark, sf_dir, "documents")
    return dq.evaluate(lines, [dq.unique(lines, ["l_orderkey", "l_linenumber"])]).unionByName(
        dq.evaluate(documents, [dq.unique(documents, ["text"])])
    )


@query
def dq_row_count(spark, sf_dir):
    return dq.evaluate(views.table(spark, sf_dir, "orders"), [dq.min_rows(10), dq.min_rows(10**15)])


@query
def dq_freshness(spark, sf_dir):
    events = _events(spark, sf_dir)
    return dq.evaluate(events, [dq.freshness("ts", 48, _moment("2024-01-30 23:59:59"))])


@query
def dq_referential(spark, sf_dir):
    """Retailer districts against a master that lacks one state."""
    master = views.districts(spark, sf_dir).filter("state <> 'ASIA'")
    return dq.referential(layers.silver_retailers(spark, sf_dir), ["district"], master)


@query
def dq_suite_retailer(spark, sf_dir):
    frame = silver.type_retailers(views.dirty_retailer_weeks(spark, sf_dir))
    return dq.evaluate(frame, silver.retailer_rules(frame))


@query
def dq_suite_district(spark, sf_dir):
    frame = layers.silver_districts(spark, sf_dir)
    return dq.evaluate(frame, silver.district_rules(frame))


@query
def dq_suite_demand(spark, sf_dir):
    frame = layers.silver_demand(spark, sf_dir)
    return dq.evaluate(frame, silver.demand_rules(frame))


def _report(spark, sf_dir) -> DataFrame:
    """Reports of a clean and a dirty table, written as JSON and read back."""
    path = fresh_path(spark, "dq-report")
    dirty = silver.type_retailers(views.dirty_retailer_weeks(spark, sf_dir))
    clean = layers.silver_districts(spark, sf_dir)
    for table, frame, rules in (
        ("retailer", dirty, silver.retailer_rules(dirty)),
        ("district", clean, silver.district_rules(clean)),
    ):
        document = dq.report(dq.checked(frame, rules), table, _moment(LOAD_TIME))
        document.coalesce(1).write.mode("append").json(path)
    return spark.read.schema(document.schema).json(path)


@query
def dq_report(spark, sf_dir):
    """The JSON report documents, one row per rule."""
    return _report(spark, sf_dir).select("table", "run_time", "overall_passed", F.inline("rules"))


@query
def dq_alerts(spark, sf_dir):
    """One message per table with failed rules."""
    return dq.alerts(_report(spark, sf_dir))


# --- Mart --------------------------------------------------------------------------


def _fact(spark, sf_dir, table: str) -> DataFrame:
    return mart.to_fact(layers.stored_gold(spark, sf_dir, table), table, _moment(LOAD_TIME))


@query
def mart_load_retailer(spark, sf_dir):
    return _fact(spark, sf_dir, "retailer_kpi")


@query
def mart_load_district(spark, sf_dir):
    return _fact(spark, sf_dir, "district_risk")


@query
def mart_load_demand(spark, sf_dir):
    return _fact(spark, sf_dir, "demand_forecast")


@query
def mart_partition_load(spark, sf_dir):
    """Only one day of Gold goes to staging."""
    day = mart.partition_of(layers.stored_gold(spark, sf_dir, "retailer_kpi"), KPI_DAY)
    return mart.to_fact(day, "retailer_kpi", _moment(LOAD_TIME)).select(
        "retailer_id", "week", "state", "rps_score", "ingestion_date"
    )


def _upsert_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Facts loaded so far, and a staging set that overlaps and extends them."""
    kpi = layers.stored_gold(spark, sf_dir, "retailer_kpi").select(
        "retailer_id", "week", "avg_weekly_revenue", "visit_urgency", "ingestion_date"
    )
    loaded = kpi.filter("ingestion_date <= '2024-01-20'")
    staged = kpi.filter("ingestion_date >= '2024-01-15'").withColumn(
        "avg_weekly_revenue", F.col("avg_weekly_revenue") + 1000
    )
    return loaded, staged


@query
def mart_delete_matched(spark, sf_dir):
    loaded, staged = _upsert_sides(spark, sf_dir)
    return delete_matched(loaded, staged, schemas.UPSERT_KEYS)


@query
def mart_upsert(spark, sf_dir):
    """Two loads into a versioned table: insert, then replace by key."""
    path = fresh_path(spark, "fact")
    loaded, staged = _upsert_sides(spark, sf_dir)
    mart.apply_upsert(spark, loaded, path)
    mart.apply_upsert(spark, staged, path)
    return lake.read_version(spark, path)


@query
def mart_upsert_partitions(spark, sf_dir):
    """The same two loads into a table partitioned by week, replacing only staged weeks."""
    path = fresh_path(spark, "fact-by-week")
    loaded, staged = _upsert_sides(spark, sf_dir)
    mart.upsert_partitions(spark, loaded, path)
    mart.upsert_partitions(spark, staged, path)
    return spark.read.schema(staged.schema).parquet(path)


@query
def mart_rejects(spark, sf_dir):
    """Rows the fact table may not hold, with the reasons."""
    kpi = layers.stored_gold(spark, sf_dir, "retailer_kpi").withColumns(
        {
            "district": F.when(F.col("stockout_events") <= 1, F.col("district")),
            "week": F.when(F.col("revenue_tier") == "HIGH", F.concat("week", F.lit("-final"))).otherwise(F.col("week")),
        }
    )
    return mart.rejects(kpi, "retailer_kpi").select(
        "retailer_id", "week", "state", F.concat_ws("; ", "reasons").alias("reasons")
    )


@query
def mart_load_rejects(spark, sf_dir):
    """A load in which values overflow, keys are missing and texts are too long: both sides, with the reasons."""
    path = fresh_path(spark, "mart")
    kpi = layers.stored_gold(spark, sf_dir, "retailer_kpi").withColumns(
        {
            "district": F.when(F.col("stockout_events") <= 1, F.col("district")),
            "week": F.when(F.col("revenue_tier") == "HIGH", F.concat("week", F.lit("-final"))).otherwise(F.col("week")),
            "stockout_events": F.when(F.col("visit_urgency") == "URGENT", F.lit(5_000_000_000)).otherwise(F.col("stockout_events").cast("bigint")),
        }
    )
    counts = mart.load_fact(spark, kpi, "retailer_kpi", path, _moment(LOAD_TIME))
    sides = [lake.read_optional(spark, f"{path}/{part}retailer_kpi") for part in ("", "rejects/")]
    rows = [f.select("retailer_id", "week", "state", "stockout_events", F.concat_ws("; ", f["reasons"] if "reasons" in f.columns else F.array()).alias("reasons")) for f in sides if f is not None]
    return reduce(DataFrame.unionByName, rows).withColumn("rows_read", F.lit(counts["read"]).cast("bigint"))


@query
def mart_upsert_new_column(spark, sf_dir):
    """An increment with a column the stored table lacks, by partition: old rows read it as NULL."""
    path = fresh_path(spark, "fact-by-week")
    loaded, staged = _upsert_sides(spark, sf_dir)
    mart.upsert_partitions(spark, loaded, path)
    mart.upsert_partitions(spark, staged.withColumn("channel", F.concat(F.lit("c-"), "visit_urgency")), path)
    return lake.read_optional(spark, path).select("retailer_id", "week", "avg_weekly_revenue", "channel")


@query
def dim_district_two_loads(spark, sf_dir):
    """The district dimension after two loads; keys of the first stay when others join."""
    path = fresh_path(spark, "dim-district")
    every = views.districts(spark, sf_dir).select("state", "district")
    mart.maintain_districts(spark, every.filter("state > 'AMERICA'"), path, _moment(LOAD_TIME))
    mart.maintain_districts(spark, every, path, _moment("2024-02-01 00:00:00"))
    return lake.read_version(spark, path).drop("region")


@query
def mart_layout(spark, sf_dir):
    """Fact bucketed by district; the grouping reads the buckets without a shuffle."""
    name = f"fieldmart_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name, fresh_path(spark, "catalog"))
    fact = catalog.save_bucketed(
        layers.stored_gold(spark, sf_dir, "retailer_kpi"), f"{name}.fact_retailer_kpi", fresh_path(spark, "bucketed"),
        "district", schemas.FACT_SORT_KEYS["retailer_kpi"], 8, ["retailer_id"],
    )
    return fact.groupBy("district").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("stockout_risk_flag").alias("at_risk"), F.max("rps_score").alias("max_rps")
    )


@query
def dim_district(spark, sf_dir):
    """Districts with a surrogate key."""
    return mart.district_dimension(views.districts(spark, sf_dir)).drop("created_at")


@query
def run_audit(spark, sf_dir):
    """A whole run from CSV to Gold with re-delivered rows, and its log entry."""
    raw, target = fresh_path(spark, "raw"), fresh_path(spark, "lake")
    retailer = stage(views.retailer_weeks(spark, sf_dir).select(schemas.RAW_RETAILERS.fieldNames()), "weeks")
    _raw_csv(retailer, raw, "features_retailers")
    _raw_csv(retailer, raw, "features_retailers")
    _raw_csv(
        views.district_days(spark, sf_dir).select(schemas.RAW_DISTRICTS.fieldNames()), raw, "features_district_risk"
    )
    _raw_csv(
        views.inventory(spark, sf_dir).select(schemas.RAW_INVENTORY.fieldNames()), raw, "retailer_inventory_weekly"
    )
    medallion.run(spark, raw, target, "scheduled")
    return medallion.run_log(spark, target).select(
        "status", "rows_bronze", "rows_silver", "rows_gold", "dq_failures", "triggered_by"
    )


@query
def run_alerts(spark, sf_dir):
    """Alerts that a run writes by itself: rows delivered twice break the key rule of one table."""
    raw, target = fresh_path(spark, "raw"), fresh_path(spark, "lake")
    retailer = stage(views.retailer_weeks(spark, sf_dir).select(schemas.RAW_RETAILERS.fieldNames()), "weeks")
    for _ in range(2):
        _raw_csv(retailer, raw, "features_retailers")
    _raw_csv(views.district_days(spark, sf_dir).select(schemas.RAW_DISTRICTS.fieldNames()), raw, "features_district_risk")
    medallion.run(spark, raw, target, run_id="r1", environment="test")
    return medallion.alerts(spark, target).select("table_name", "subject", "failed_rules", "execution_id", "run_id")


# --- Metrics and events --------------------------------------------------------------


@query
def metric_rollup_hourly(spark, sf_dir):
    return metrics.rollup(_events(spark, sf_dir), "1 hour", ["event_type"])


@query
def metric_rollup_daily(spark, sf_dir):
    return metrics.rollup(_events(spark, sf_dir), "1 day", ["event_type"])


@query
def metric_status_daily(spark, sf_dir):
    kind = F.col("event_type")
    return metrics.status_counts(_events(spark, sf_dir), "1 day", kind == "purchase", kind == "error")


@query
def alarm_windows(spark, sf_dir):
    """Five-minute windows with at least one failure."""
    return metrics.alarms(_events(spark, sf_dir), (F.col("event_type") == "error").cast("int"))


@query
def log_error_tail(spark, sf_dir):
    """The newest log lines that mention an error."""
    log = _events(spark, sf_dir).select(
        "event_id", "ts", F.concat_ws(" ", F.upper("event_type"), "props").alias("message")
    )
    return metrics.error_tail(log, "message", "ts", "event_id")


@query
def arrival_events_parse(spark, sf_dir):
    """Arrival events as JSON text -> files that start a load."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)

    def record(key: str, size=None):
        parts = [F.format_string(key, F.col("page_id")).alias("key")]
        if size is not None:
            parts.append(size.alias("size"))
        body = F.struct(F.struct(host.alias("name")).alias("bucket"), F.struct(*parts, *(
            [] if size is not None else [F.lit(None).cast("bigint").alias("size")]
        )).alias("object"))
        return F.struct(body.alias("s3"))

    size = F.length("html").cast("bigint")
    records = F.array(
        record("raw/pages/%d.csv", size), record("raw/late/%d.csv"),
        record("raw/pages/%d.json", size), record("tmp/%d.csv", size),
    )
    events = views.table(spark, sf_dir, "pages").select(
        "page_id", F.to_json(F.struct(records.alias("Records"))).alias("event")
    )
    return metrics.triggering(metrics.arrivals(events))


# --- Streaming ------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a file stream; the glob also matches a folder of parts."""
    schema = views.table(spark, sf_dir, "events").schema
    rows = jobs.read_files(spark, f"{sf_dir}/events.parque[t]", schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_bronze(spark, sf_dir):
    """CSV files picked up once each and appended to Bronze."""
    landing, target = fresh_path(spark, "landing"), fresh_path(spark, "bronze")
    columns = schemas.RAW_RETAILERS.fieldNames()
    _raw_csv(views.retailer_weeks(spark, sf_dir).select(columns), landing, "features_retailers")
    checkpoint = fresh_path(spark, "offsets")
    for _ in range(2):  # a second start finds nothing new
        jobs.ingest_csv(
            spark, landing, schemas.RAW_RETAILERS, target, checkpoint, _moment(LOAD_TIME)
        ).awaitTermination()
    return spark.read.parquet(target).select("retailer_id", "week", "avg_weekly_revenue", "ingestion_date")


@query
def stream_dedup(spark, sf_dir):
    """Events delivered twice, kept once."""
    landing, target = fresh_path(spark, "landing"), fresh_path(spark, "deduplicated")
    events = _events(spark, sf_dir)
    for delivery in (1, 2):
        events.write.parquet(f"{landing}/delivery={delivery}")
    rows = jobs.read_files(
        spark, landing, T.StructType(events.schema.fields + [T.StructField("delivery", T.IntegerType())])
    )
    kept = jobs.drop_redelivered(rows, ["event_id"], source="delivery").drop("delivery")
    jobs.append_parquet(kept, target, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", "value")


@query
def stream_late_rows(spark, sf_dir):
    """Events of odd number delivered after all others: those behind the watermark are counted, the rest kept."""
    landing, target, counts, checkpoint = (fresh_path(spark, n) for n in ("landing", "on-time", "late", "offsets"))
    events = _events(spark, sf_dir)
    for odd in (0, 1):
        events.filter(F.col("event_id") % 2 == odd).write.mode("append").parquet(landing)
        rows = jobs.read_files(spark, landing, events.schema)
        kept = jobs.drop_redelivered(rows, ["event_id"], delay="10 days")
        run = jobs.append_parquet(kept, target, checkpoint)
        run.awaitTermination()
        late.keep_recent(run, spark, counts)
    found = late.late_rows(spark, counts).agg(F.coalesce(F.sum("n_late"), F.lit(0)).alias("late"))
    return found.crossJoin(spark.read.parquet(target).agg(F.count("*").alias("kept")))  # one row each


@query
def stream_metric_rollup(spark, sf_dir):
    """Hourly metrics of the windows the watermark has closed."""
    target = fresh_path(spark, "rollup")
    rows = jobs.rollup(_event_stream(spark, sf_dir), "1 hour", ["event_type"])
    jobs.append_parquet(rows, target, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target)


@query
def stream_alarm(spark, sf_dir):
    """Five-minute alarms of the windows the watermark has closed."""
    target = fresh_path(spark, "alarms")
    rows = jobs.alarms(_event_stream(spark, sf_dir), (F.col("event_type") == "error").cast("int"))
    jobs.append_parquet(rows, target, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target)


@query
def stream_upsert(spark, sf_dir):
    """Staged rows arriving as files, merged by key into the fact table."""
    landing, path = fresh_path(spark, "landing"), fresh_path(spark, "fact")
    loaded, staged = _upsert_sides(spark, sf_dir)
    lake.write_version(loaded, path)
    staged.write.parquet(landing)
    rows = jobs.read_files(spark, landing, staged.schema)
    jobs.upsert_into(
        rows, path, schemas.UPSERT_KEYS, "ingestion_date", fresh_path(spark, "offsets")
    ).awaitTermination()
    return lake.read_version(spark, path)


@query
def stream_upsert_ordered(spark, sf_dir):
    """Two batches, the later one older: newest rows stay, in a table partitioned by week."""
    landing, path, offsets = fresh_path(spark, "landing"), fresh_path(spark, "fact-by-week"), fresh_path(spark, "offsets")
    loaded, staged = _upsert_sides(spark, sf_dir)
    late = staged.withColumns({"ingestion_date": F.date_sub("ingestion_date", 3), "avg_weekly_revenue": F.col("avg_weekly_revenue") + 1000})
    mart.upsert_partitions(spark, loaded, path)
    for batch in (staged, late):
        batch.write.mode("append").parquet(landing)
        jobs.upsert_into(
            jobs.read_files(spark, landing, staged.schema), path, schemas.UPSERT_KEYS, "ingestion_date", offsets, partition_by="week"
        ).awaitTermination()
    return spark.read.schema(staged.schema).parquet(path)


@query
def stream_bronze_routed(spark, sf_dir):
    """One stream over the files of two datasets, each routed to its Bronze table."""
    landing, target, offsets = fresh_path(spark, "landing"), fresh_path(spark, "bronze"), fresh_path(spark, "offsets")
    _raw_csv(views.retailer_weeks(spark, sf_dir).select(schemas.RAW_RETAILERS.fieldNames()), landing, "features_retailers")
    for frame in (views.district_days(spark, sf_dir), views.district_days(spark, sf_dir).limit(0)):
        _raw_csv(frame.select(schemas.RAW_DISTRICTS.fieldNames()), landing, "features_district_risk")
        jobs.ingest_routed(spark, landing, target, offsets, ingested_at=_moment(LOAD_TIME)).awaitTermination()
    weeks = bronze.read_bronze(spark, target, "features_retailers").select(F.lit("retailer").alias("dataset"), F.col("retailer_id").alias("key"), F.col("week").alias("period"), F.col("avg_weekly_revenue").alias("measure"))
    days = bronze.read_bronze(spark, target, "features_district_risk").select(F.lit("district").alias("dataset"), F.col("district").alias("key"), F.col("date").alias("period"), F.col("precip_mm_7d").alias("measure"))
    return weeks.unionByName(days)
