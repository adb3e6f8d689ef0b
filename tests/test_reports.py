import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmart.catalogue import layers
from fieldmart.operators import scores
from fieldmart.plans import reports, silver

DAY, EARLIER = datetime.date(2024, 1, 30), datetime.date(2024, 1, 1)
KPI = (
    "retailer_id string, retailer_name string, state string, district string, tehsil string, week string, "
    "avg_weekly_revenue double, revenue_tier string, revenue_wow_pct double, rps_score double, "
    "stockout_risk_flag int, visit_urgency string, ingestion_date date"
)
RISK = (
    "district string, state string, date string, drs_score double, drs_7d_avg double, drs_trend string, "
    "risk_tier string, total_pest_alerts int, high_incidence_count int, recommended_product string, ingestion_date date"
)


def kpi(spark, rows):
    """(id, state, score, urgency, day) rows."""
    full = [(i, i, s, "d", "t", "w", 1234.5, "LOW", None, score, 1, urgency, day) for i, s, score, urgency, day in rows]
    return spark.createDataFrame(full, KPI)


def test_urgent_retailers_are_ordered_with_a_tie_break(spark):
    rows = [(f"R{i:02d}", "s", 0.5, "URGENT", DAY) for i in range(12)]
    rows += [("R98", "s", 0.9, "URGENT", DAY), ("R99", "s", 0.99, "ROUTINE", DAY), ("R97", "s", 1.0, "URGENT", EARLIER)]
    got = reports.urgent_retailers(kpi(spark, rows), DAY)
    assert [r["retailer_id"] for r in got.collect()] == ["R98"] + [f"R{i:02d}" for i in range(9)]
    assert got.first()["revenue_inr"] == 1235.0
    assert reports.urgent_retailers(kpi(spark, rows)).count() == 10  # newest day by default


def test_trailing_ranges_include_their_first_day(spark):
    rows = [("a", "s", 0.5, "URGENT", datetime.date(2023, 12, 31)), ("a", "s", 0.5, "URGENT", datetime.date(2023, 12, 30)),
            ("b", "s", None, "SOON", DAY)]
    trend = reports.revenue_trend(kpi(spark, rows), DAY).collect()
    assert [(r["active_retailers"], r["urgent_visits"], r["avg_rps"], r["stockout_risk_count"]) for r in trend] == [(2, 1, 0.5, 2)]
    assert reports.revenue_trend(kpi(spark, rows)).collect() == trend  # newest day by default
    health = reports.daily_health(kpi(spark, rows), DAY, days=31).collect()
    assert [str(r["ingestion_date"]) for r in health] == ["2024-01-30", "2023-12-31", "2023-12-30"]
    assert health[0]["mean_rps"] is None and health[0]["soon_count"] == 1


def test_heatmap_and_cross_layer_priority(spark):
    risk = spark.createDataFrame(
        [("d", "s", "x", 0.8, 0.7, "UP", "HIGH", 1, 1, "p", DAY), ("d", "s2", "x", 0.9, 0.7, "UP", "HIGH", 1, 1, "p", EARLIER),
         ("e", "s", "x", 0.4, 0.7, "UP", "MEDIUM", 1, 1, "p", DAY), ("f", "s", "x", 0.1, 0.7, "UP", "LOW", 1, 1, "p", DAY)],
        RISK,
    )
    assert [r["district"] for r in reports.district_heatmap(risk, DAY).collect()] == ["d", "e"]
    rows = [("R1", "s", 0.5, "SOON", DAY), ("R2", "s", None, "SOON", DAY), ("R3", "s2", 0.9, "SOON", DAY)]
    got = reports.cross_layer_priority(kpi(spark, rows), risk, DAY).collect()
    assert [(r["retailer_id"], r["combined_priority_score"]) for r in got] == [("R1", 0.62), ("R2", None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.floats(0, 1e6), st.integers(0, 500), st.integers(0, 50), st.floats(0, 1e4), st.floats(0, 10)),
        min_size=1, max_size=30,
    )
)
def test_scores_lie_between_zero_and_one(spark, rows):
    frame = spark.createDataFrame(
        rows,
        "avg_weekly_revenue double, days_since_last_visit int, stockout_events int, avg_depletion_rate double, weeks_of_stock double",
    )
    got = scores.retailer_priority(silver.type_retailers(frame)).agg(F.min("rps_score"), F.max("rps_score")).first()
    assert 0 <= got[0] <= got[1] <= 1


def test_derived_tables_follow_their_input(spark, tmp_path):
    for name in ("events", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = layers.silver_districts(spark, str(tmp_path)).count()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 100").write.mode("overwrite").parquet(
        str(tmp_path / "events.parquet")
    )
    assert 0 < layers.silver_districts(spark, str(tmp_path)).count() < before
