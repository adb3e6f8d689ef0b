"""The physical plans the jobs are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

from fieldmart.catalogue import layers, queries, views
from fieldmart.operators import dq, scores, windows
from fieldmart.plans import gold, reports, silver


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan_of(frame) -> str:
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return plan_of(frame).split("== Initial Plan ==")[0]


def top_level(plan: str) -> str:
    """The plan without its sub-queries."""
    return plan.split("===== Subqueries =====")[0]


@pytest.mark.parametrize("table", ["retailer_kpi", "district_risk", "demand_forecast"])
def test_gold_plans_have_no_product_and_no_single_task_stage(spark, sf_dir, table):
    plan = plan_of(layers.computed_gold(spark, sf_dir, table))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Only the one-row aggregate of the extremes may end in a single partition.
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            assert table != "demand_forecast"
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_no_registered_query_plans_a_product(spark, sf_dir):
    lazy = [n for n in queries.queries() if re.match(r"(q\d|gold_(retailer|district|demand)|dq_(not|non|uni|row|fre|ref|suite)|metric|alarm|silver|mart_(load|partition|delete))", n)]
    assert len(lazy) > 25
    for name in lazy:
        plan = plan_of(queries.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_dedup_limits_groups_before_the_shuffle(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    plan = plan_of(windows.keep_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate"))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 1, Partial", plan)
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange") < plan.index("row_number(), 1, Partial")


def test_top_k_limits_groups_before_the_shuffle_and_never_ranks_a_whole_group(spark, sf_dir):
    scored = scores.retailer_priority(layers.silver_retailers(spark, sf_dir))
    plan = plan_of(windows.flag_top5_in_tehsil(scored))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 5, Partial", plan)
    assert " rank(" not in plan


def test_staged_cut_offs_are_broadcast_so_the_rows_are_not_shuffled(spark, sf_dir):
    scored = scores.retailer_priority(layers.silver_retailers(spark, sf_dir))
    plan = plan_of(windows.flag_top5_in_tehsil(scored, stage_cut_offs=True))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_extremes_run_once(spark, sf_dir):
    plan = final_plan_of(layers.computed_gold(spark, sf_dir, "retailer_kpi"))
    executed = [line for line in plan.splitlines() if re.search(r"\bSubquery subquery#", line) and "Reused" not in line]
    assert len({re.search(r"subquery#(\d+)", line).group(1) for line in executed}) == 1


def test_average_and_slope_share_one_window_sort_and_exchange(spark):
    frame = spark.range(10).selectExpr("'s' sku_id", "'d' district", "cast(id as string) week", "cast(id as double) actual_qty")
    plan = plan_of(frame.transform(windows.moving_average).transform(windows.trend_slope))
    assert len(re.findall(r"\+- Window|Window \[", plan)) in (1, 2) and plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_demand_series_is_shuffled_twice_and_hash_aggregated_first(spark, sf_dir):
    series = gold.demand_series(layers.silver_demand(spark, sf_dir))
    plan = plan_of(series.transform(windows.moving_average).transform(windows.trend_slope))
    assert plan.count("Exchange") == 2
    assert plan.splitlines()[-2].strip().startswith("+- HashAggregate")


def test_reports_prune_partitions_and_columns(spark, sf_dir):
    kpi = layers.stored_gold(spark, sf_dir, "retailer_kpi")
    plan = plan_of(reports.urgent_retailers(kpi, views.KPI_DAY))
    assert re.search(r"PartitionFilters: \[isnotnull\(ingestion_date#\d+\), \(ingestion_date#\d+ = 2024-01-30\)\]", plan)
    assert "EqualTo(visit_urgency,URGENT)" in plan and "TakeOrderedAndProject(limit=10" in plan
    trend = plan_of(reports.revenue_trend(kpi, views.KPI_DAY))
    schema = re.search(r"ReadSchema: (\S+)", trend).group(1)
    assert "retailer_name" not in schema and "weeks_of_stock" not in schema


def test_gold_write_rebalances_and_measures_after_the_exchange(spark, sf_dir):
    frame = layers.silver_districts(spark, sf_dir).hint("rebalance", F.col("state"), F.col("ingestion_date"))
    plan = plan_of(frame)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


def test_a_rule_suite_scans_its_table_once(spark, sf_dir):
    frame = silver.type_retailers(layers.silver_retailers(spark, sf_dir).drop("stockout_risk_flag", "revenue_tier"))
    plan = plan_of(dq.evaluate(frame, silver.retailer_rules(frame)))
    assert plan.count("FileScan") == 1
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "retailer_name" not in schema


def test_referential_counts_per_key_before_the_join(spark, sf_dir):
    plan = plan_of(
        dq.referential(layers.silver_retailers(spark, sf_dir), ["district"], views.districts(spark, sf_dir))
    )
    join = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[district", plan)
    assert join and "partial_count" in plan[join.end():]


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    plan = plan_of(views.retailer_weeks(spark, sf_dir))
    lineitem = next(line for line in plan.splitlines() if "l_orderkey" in line and "FileScan" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in lineitem


def exchanged(plan, kind=r"hashpartitioning\((.*?), \d+\)"):
    """Columns of every shuffle by key."""
    return [re.sub(r"#\d+L?", "", found) for found in re.findall(f"Exchange {kind}", plan)]


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_retailer_weeks_shuffle_orders_once_by_customer(spark, sf_dir, no_broadcast):
    plan = plan_of(views.retailer_weeks(spark, sf_dir))
    assert [c for c in exchanged(plan) if c.startswith("o_custkey")] == ["o_custkey"]


def test_enriched_stock_is_summed_in_the_shuffle_of_its_join(spark, sf_dir, no_broadcast):
    lines = silver.enrich_inventory(views.sold_lines(spark, sf_dir), views.retailers(spark, sf_dir))
    plan = plan_of(views.stock_of(lines, ["district", "state"]))
    # One shuffle of the lines, one of the master.
    assert [c for c in exchanged(plan) if "p_type" in c] == [] and exchanged(plan).count("retailer_id") == 2


def test_customers_of_one_key_keep_a_row_each(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(1, "c", 0, "m"), (1, "c", 0, "m"), (2, "d", 0, "m")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    orders = spark.createDataFrame([(10, 1, "P", 12.34, "1997-03-03 00:00:00"), (11, 1, "O", 1.0, "1997-03-09 00:00:00"), (12, 2, None, None, None)],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    write("lineitem", [(10, 7.0), (10, 3.0)], "l_orderkey long, l_quantity double")
    rows = views.retailer_weeks(spark, str(tmp_path)).select("retailer_id", "week", "avg_weekly_revenue", "stockout_events", "avg_depletion_rate", "weeks_of_stock").collect()
    twice = ("R1", "1997-W10", 1.334, 1, 10 / 7, 0.6)
    assert sorted(map(tuple, rows)) == [twice, twice, ("R2", None, None, 0, None, None)]


def test_gold_retailer_rows_are_shuffled_once_by_retailer(spark, sf_dir, no_broadcast):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")  # the staged cut-offs are small
    plan = plan_of(layers.computed_gold(spark, sf_dir, "retailer_kpi"))
    assert exchanged(top_level(plan)) == ["retailer_id"]


def test_tasks_read_small_shares_of_a_shuffle(spark):
    # 64 MB of a shuffle unfold to more than 1 GB in a task.
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
