"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Each query
runs ``BENCH_RUNS`` times into a sink that discards rows, and the median counts.
``build_lake`` is the cold build of the Silver and Gold tables from the given
tables; the business queries then read Gold as they would in a lake.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldmart.catalogue import layers, queries  # noqa: E402
from fieldmart.schemas import GOLD_TABLES  # noqa: E402
from fieldmart.session import build_session  # noqa: E402

HEADLINE = (
    "gold_retailer_kpi", "gold_district_risk", "gold_demand_forecast", "gold_anomalies",
    "q1_urgent_retailers", "q2_district_heatmap", "q3_revenue_trend", "q4_growing_demand",
    "q5_daily_health", "q6_cross_layer_priority", "district_avg_risk",
    "dq_suite_retailer", "dq_suite_district", "dq_suite_demand",
    "silver_retailer", "enrich_inventory", "dedup_latest", "top5_in_group",
    "mart_load_retailer", "mart_upsert", "metric_rollup_hourly", "alarm_windows",
)


def executions(spark) -> int:
    """Actions Spark SQL has run so far in this application."""
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def run_once(spark, name: str, sf_dir: str, actions: dict[str, int]) -> float:
    before = executions(spark)
    start = time.perf_counter()
    queries.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - start
    actions[name] = executions(spark) - before
    return elapsed


def build_lake(spark, sf_dir: str) -> float:
    layers.forget()
    start = time.perf_counter()
    for table in GOLD_TABLES:
        layers.gold_path(spark, sf_dir, table)
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "fieldmart-bench", f"local[{cpus}]", cpus,
        {"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {"build_lake": build_lake(spark, sf_dir)}
    actions = {"build_lake": executions(spark)}
    for name in HEADLINE:
        times[name] = statistics.median(run_once(spark, name, sf_dir, actions) for _ in range(runs))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in times.items()},
                "actions": actions,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
