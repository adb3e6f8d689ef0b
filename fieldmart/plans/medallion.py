"""The whole flow in one session: Bronze, Silver, Gold and the run log."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.operators import dq
from fieldmart.plans import bronze, gold, partial_gold, silver
from fieldmart.schemas import RUN_LOG
from fieldmart.sources import files
from fieldmart.sources.lake import read_optional


def run(
    spark: SparkSession,
    raw: str,
    lake: str,
    triggered_by: str = "manual",
    run_id: str | None = None,
    execution_arn: str | None = None,
    max_age_hours: int | None = None,
    district_master: DataFrame | None = None,
    day: str | None = None,
    incremental: bool = False,
    environment: str | None = None,
    partial: bool = False,
    publish: bool = False,
) -> dict[str, dict[str, int]]:
    """Ingest ``raw`` and rebuild the lake; a run-log row is written either way.

    With ``day`` Silver takes in only what Bronze holds of that day.  With ``incremental``
    Bronze reads only files that its ingest log does not have; a lake is filled one way or
    the other, not by both.  With ``partial`` the retailer and district tables of Gold take
    in what changed in Silver (see ``partial_gold``); the forecast is always rebuilt.  With
    ``publish`` rebuilt tables are new versions beside the old, read by ``read_optional``.

    Layers are handed over as Parquet, so a failed run can restart at any layer.
    Returns rows per table of each layer.
    """
    run_id = run_id or uuid.uuid4().hex
    started = datetime.now(timezone.utc)
    counts: dict[str, dict[str, int]] = {"bronze": {}, "silver": {}, "gold": {}}
    status = "FAILED"
    try:
        counts["bronze"] = (bronze.ingest_new if incremental else bronze.ingest)(spark, raw, f"{lake}/bronze")
        counts["silver"] = silver.refine(
            spark, f"{lake}/bronze", f"{lake}/silver", f"{lake}/dq_reports/run_id={run_id}",
            max_age_hours=max_age_hours, district_master=district_master, day=day, publish=publish,
        )
        write_alerts(spark, lake, run_id, environment)
        counts["gold"] = build_gold(spark, lake, partial, publish)
        status = "SUCCESS"
    finally:
        log_run(spark, lake, run_id, execution_arn, started, status, counts, triggered_by)
    return counts


def write_alerts(spark: SparkSession, lake: str, run_id: str, environment: str | None = None) -> None:
    """Add a row to ``dq_alerts`` for every table of this run with failed rules.

    The folder of the run is replaced, so writing again adds nothing.
    """
    path = f"{lake}/dq_reports/run_id={run_id}"
    if not files.exists(spark, path):
        return  # no table had input
    found = dq.alerts(spark.read.schema(dq.REPORT).json(path), environment, path, run_id)
    found.coalesce(1).write.mode("overwrite").parquet(f"{lake}/dq_alerts/run_id={run_id}")


def alerts(spark: SparkSession, lake: str) -> DataFrame | None:
    """Alert rows of all runs."""
    return read_optional(spark, f"{lake}/dq_alerts")


def build_gold(spark: SparkSession, lake: str, partial: bool = False, publish: bool = False) -> dict[str, int]:
    """Every Gold table whose Silver input exists; rows written per table."""
    plans = {
        "retailer_kpi": ("retailer", lambda df: gold.retailer_kpi(df, stage_cut_offs=True)),
        "district_risk": ("district", gold.district_risk),
        "demand_forecast": ("demand", lambda df: gold.demand_forecast(gold.demand_series(df))),
    }
    rows = {}
    for table, (source, plan) in plans.items():
        paths = f"{lake}/silver/{source}", f"{lake}/gold/{table}"
        frame = read_optional(spark, paths[0])
        if frame is None:
            continue
        if partial and table in partial_gold.TABLES:
            done = partial_gold.refresh(spark, partial_gold.TABLES[table], *paths, f"{lake}/gold_state/{table}", publish)
            rows[table] = done["rows"]
        else:
            rows[table] = gold.write_gold(plan(frame), table, paths[1], publish)["rows"]
    return rows


def failures_of(reports: DataFrame) -> DataFrame:
    """Number of failed rules over all reports: one row."""
    failed = F.size(F.filter("rules", lambda rule: ~rule["passed"]))
    return reports.agg(F.coalesce(F.sum(failed), F.lit(0)).cast("int").alias("dq_failures"))


def log_run(spark, lake, run_id, execution_arn, started, status, counts, triggered_by) -> None:
    """Append one row to the run log."""
    path = f"{lake}/dq_reports/run_id={run_id}"
    failures = 0
    if counts["silver"]:
        failures = failures_of(spark.read.json(path)).first()["dq_failures"]
    ended = datetime.now(timezone.utc)
    row = (
        run_id, execution_arn, "fieldmart", started, ended, status,
        sum(counts["bronze"].values()), sum(counts["silver"].values()), sum(counts["gold"].values()),
        failures, triggered_by, ended,
    )
    spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(f"{lake}/run_log")


def run_log(spark: SparkSession, lake: str) -> DataFrame | None:
    return read_optional(spark, f"{lake}/run_log", RUN_LOG)
