import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmart.functions import classify
from fieldmart.operators import scores
from fieldmart.operators.forecast import project_demand
from fieldmart.operators.windows import keep_latest
from fieldmart.plans import gold, silver
from samples import (
    DISTRICT_GOLDEN, DISTRICT_SCHEMA, DISTRICTS, RETAILER_GOLDEN, RETAILER_SCHEMA, RETAILERS,
)


def retailers(spark):
    return silver.type_retailers(spark.createDataFrame(RETAILERS, RETAILER_SCHEMA))


def test_retailer_sample_matches_the_golden_values(spark):
    clean = keep_latest(retailers(spark), silver.RETAILER_KEYS)
    assert clean.count() == 5
    rows = {r["retailer_id"]: r for r in gold.retailer_kpi(clean.withColumn("ingestion_date", F.current_date())).collect()}
    for key, (score, urgency, tier) in RETAILER_GOLDEN.items():
        assert (rows[key]["rps_score"], rows[key]["visit_urgency"], rows[key]["revenue_tier"]) == (score, urgency, tier)


def test_district_sample_matches_the_golden_values(spark):
    frame = silver.type_districts(spark.createDataFrame(DISTRICTS, DISTRICT_SCHEMA))
    rows = {r["district"]: r for r in gold.district_risk(frame).collect()}
    for key, (score, tier, product) in DISTRICT_GOLDEN.items():
        row = rows[key]
        assert (row["drs_score"], row["risk_tier"], row["recommended_product"]) == (score, tier, product)
        assert row["drs_trend"] == "STABLE" and row["drs_7d_avg"] == score


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, 2.0, 3.0], [0.0, 0.5, 1.0]),
        ([4.0, 4.0], [0.0, 0.0]),  # no span
        ([-5.0, 0.0], [0.0, 5 / 6]),  # a maximum of 0 counts as 1
        ([0.0, 0.0], [0.0, 0.0]),
        ([None, 2.0], [None, 0.0]),
        ([None, None], [None, None]),
    ],
)
def test_min_max_norm_edges(spark, values, expected):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    rows = scores.min_max_norm(frame, {"x": "norm"}).orderBy("i").collect()
    assert [r["norm"] for r in rows] == expected


def test_min_max_norm_on_an_empty_frame(spark):
    assert scores.min_max_norm(spark.createDataFrame([], "x double"), {"x": "norm"}).collect() == []


def test_a_missing_input_gives_a_missing_score_and_the_default_class(spark):
    rows = [("R1", 10.0, 1, 1, None, 9.0), ("R2", 20.0, 2, 2, 5.0, 9.0)]
    frame = spark.createDataFrame(
        rows,
        "retailer_id string, avg_weekly_revenue double, days_since_last_visit int, stockout_events int, "
        "avg_depletion_rate double, weeks_of_stock double",
    )
    scored = scores.retailer_priority(silver.type_retailers(frame)).withColumn("u", classify.VISIT_URGENCY.column())
    first = scored.filter("retailer_id = 'R1'").first()
    assert first["rps_score"] is None and first["u"] == "ROUTINE"


@pytest.mark.parametrize(
    "table, column, kind, cases",
    [
        (classify.STOCKOUT_RISK, "weeks_of_stock", "double", {1.99: 1, 2.0: 0, None: 0}),
        (
            classify.REVENUE_TIER, "avg_weekly_revenue", "double",
            {50000.0: "HIGH", 49999.99: "MID", 20000.0: "MID", 19999.99: "LOW", None: "LOW"},
        ),
        (classify.DROUGHT_STRESS, "precip_mm_7d", "double", {1.99: 1, 2.0: 0, None: 0}),
        (classify.HIGH_HUMIDITY, "avg_humidity_pct", "double", {80.0: 0, 80.01: 1, None: 0}),
        (
            classify.RISK_TIER, "drs_score", "double",
            {0.65: "HIGH", 0.6499: "MEDIUM", 0.35: "MEDIUM", 0.3499: "LOW", None: "LOW"},
        ),
    ],
)
def test_single_input_classes_at_their_thresholds(spark, table, column, kind, cases):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], f"i int, {column} {kind}")
    rows = frame.withColumn("out", table.column()).orderBy("i").collect()
    assert [r["out"] for r in rows] == list(cases.values())


def test_visit_urgency(spark):
    cases = [(1, 0.1, "URGENT"), (0, 0.76, "URGENT"), (0, 0.75, "SOON"), (0, 0.5, "SOON"), (0, 0.4999, "ROUTINE"),
             (None, 0.9, "URGENT"), (None, None, "ROUTINE"), (1, None, "URGENT")]
    frame = spark.createDataFrame(cases, "stockout_risk_flag int, rps_score double, want string")
    for row in frame.withColumn("got", classify.VISIT_URGENCY.column()).collect():
        assert row["got"] == row["want"], row


def test_recommended_product_takes_the_first_rule(spark):
    cases = [(1, 99, 1, "Score 250 EC"), (0, 11, 1, "Actara 25 WG"), (0, 10, 1, "Topik 15 WP"),
             (0, 10, 0, "Monitor Digital Demand"), (None, None, None, "Monitor Digital Demand")]
    frame = spark.createDataFrame(
        cases, "fungicide_risk_flag int, high_incidence_count int, drought_stress_flag int, want string"
    )
    for row in frame.withColumn("got", classify.RECOMMENDED_PRODUCT.column()).collect():
        assert row["got"] == row["want"], row


def test_demand_category(spark):
    cases = [(21.0, 100.0, "SPIKE"), (20.0, 100.0, "GROWING"), (5.0, 100.0, "STABLE"), (-5.0, 100.0, "STABLE"),
             (-5.01, 100.0, "DECLINING"), (3.0, 10.0, "SPIKE"), (1.0, None, "STABLE"), (6.0, None, "GROWING")]
    frame = spark.createDataFrame(cases, "trend_slope double, ma_4w double, want string")
    for row in frame.withColumn("got", classify.DEMAND_CATEGORY.column()).collect():
        assert row["got"] == row["want"], row


def test_classes_take_other_thresholds(spark):
    strict = classify.REVENUE_TIER.with_rules(("avg_weekly_revenue >= 10", "HIGH"))
    frame = spark.createDataFrame([(10.0,), (9.0,)], "avg_weekly_revenue double")
    assert [r[0] for r in frame.select(strict.column()).collect()] == ["HIGH", "LOW"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
def test_forecasts_stay_between_zero_and_the_cap(spark, series):
    frame = spark.createDataFrame([(round(m, 2), round(s, 2)) for m, s in series], "ma_4w double, trend_slope double")
    for row in project_demand(frame).collect():
        for n in range(1, 5):
            assert 0 <= row[f"forecasted_qty_w{n}"] <= max(0.0, 1.5 * row["ma_4w"])


def test_forecast_without_an_average_is_zero(spark):
    frame = spark.createDataFrame([(None, 0.0)], "ma_4w double, trend_slope double")
    assert project_demand(frame).first()["forecasted_qty_w1"] == 0.0
