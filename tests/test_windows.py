import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldmart.operators import windows
from fieldmart.operators.keys import dense_key
from fieldmart.plans import gold


def test_keep_latest_takes_the_newest_and_breaks_ties_the_same_way(spark):
    rows = [("a", "w1", "2024-01-01", 1), ("a", "w1", "2024-01-02", 2), ("b", "w1", "2024-01-01", 3),
            ("b", "w1", "2024-01-01", 4), (None, "w1", "2024-01-01", 5), (None, "w1", "2024-01-03", 6)]
    for seed in range(3):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        frame = spark.createDataFrame(shuffled, "k string, week string, ingestion_timestamp string, v int").repartition(3)
        once = windows.keep_latest(frame, ["k", "week"])
        assert sorted(r["v"] for r in once.collect()) == [2, 4, 6]
        assert windows.keep_latest(once, ["k", "week"]).count() == 3


def test_keep_latest_without_a_timestamp_or_keys(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    kept = windows.keep_latest(frame, ["k", "absent"])
    assert [(r["k"], r["v"], r["ingestion_timestamp"]) for r in kept.collect()] == [("a", 2, "1970-01-01")]
    assert windows.keep_latest(frame, ["absent"]).count() == 2


def test_keep_latest_with_a_key_that_holds_a_third_of_the_rows(spark):
    frame = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("ingestion_timestamp")
    )
    kept = windows.keep_latest(frame, ["k"])
    assert kept.count() == 60_001
    assert kept.filter("k = -1").first()["ingestion_timestamp"] == 89_997


def test_week_over_week_without_a_usable_base(spark):
    rows = [("a", "w1", 100.0), ("a", "w2", 150.0), ("a", "w3", 0.0), ("a", "w4", 5.0), ("a", "w5", None), ("a", "w6", 7.0)]
    frame = spark.createDataFrame(rows, "retailer_id string, week string, avg_weekly_revenue double")
    got = [r["revenue_wow_pct"] for r in windows.week_over_week_revenue(frame).orderBy("week").collect()]
    assert got == [None, 50.0, -100.0, None, None, None]


def test_week_over_week_orders_by_ingestion_date_without_weeks(spark):
    rows = [("a", "2024-01-02", 150.0), ("a", "2024-01-01", 100.0)]
    frame = spark.createDataFrame(rows, "retailer_id string, ingestion_date string, avg_weekly_revenue double")
    got = windows.week_over_week_revenue(frame).orderBy("ingestion_date").collect()
    assert [r["revenue_wow_pct"] for r in got] == [None, 50.0]


def brute_rank_flags(rows, k):
    groups = defaultdict(list)
    for tehsil, week, _, score in rows:
        groups[tehsil, week].append(score)
    out = {}
    for tehsil, week, key, score in rows:
        peers = groups[tehsil, week]
        if score is None:
            better = sum(p is not None for p in peers)
        else:
            better = sum(p is not None and p > score for p in peers)
        out[key] = 1 if better < k else 0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_top_k_flag_equals_rank_with_ties_nulls_and_a_hot_group(spark, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(3000):
        tehsil = "hot" if i % 3 == 0 else pick.choice(["a", "b", None, "c", "tiny" if i < 9 else "d"])
        score = None if pick.random() < 0.2 else round(pick.random(), 2)
        rows.append((tehsil, pick.choice(["w1", "w2", None]), i, score))
    rows += [("nulls", "w1", 10_000 + i, None) for i in range(8)]
    frame = spark.createDataFrame(rows, "tehsil string, week string, id int, rps_score double").repartition(5)
    flagged = windows.flag_top5_in_tehsil(frame, stage_cut_offs=seed % 2 == 1)
    assert {r["id"]: r["top5_in_tehsil"] for r in flagged.collect()} == brute_rank_flags(rows, 5)
    assert flagged.columns == [*frame.columns, "top5_in_tehsil"]


def test_rolling_mean_by_rows_and_by_days(spark):
    rows = [("d", f"2024-01-{day:02d}", float(day)) for day in (1, 2, 3, 10, 11)]
    frame = spark.createDataFrame(rows, "district string, date string, drs_score double")
    by_rows = [r["drs_7d_avg"] for r in windows.rolling_mean_rows(frame).orderBy("date").collect()]
    by_days = [r["drs_7d_avg"] for r in windows.rolling_mean_days(frame).orderBy("date").collect()]
    assert by_rows == [1.0, 1.5, 2.0, 4.0, 5.4]
    assert by_days == [1.0, 1.5, 2.0, 10.0, 10.5]


def test_rolling_mean_takes_seven_rows(spark):
    rows = [("d", f"2024-01-{day:02d}", float(day)) for day in range(1, 11)]
    frame = spark.createDataFrame(rows, "district string, date string, drs_score double")
    assert windows.rolling_mean_rows(frame).orderBy("date").collect()[-1]["drs_7d_avg"] == 7.0


def test_score_trend_thresholds(spark):
    rows = [("d", "2024-01-01", 0.5), ("d", "2024-01-02", 0.56), ("d", "2024-01-03", 0.52), ("d", "2024-01-04", 0.3),
            ("d", "2024-01-05", None), ("d", "2024-01-06", 0.9)]
    frame = spark.createDataFrame(rows, "district string, date string, drs_score double")
    got = [r["drs_trend"] for r in windows.score_trend(frame).orderBy("date").collect()]
    assert got == ["STABLE", "UP", "STABLE", "DOWN", "STABLE", "STABLE"]


def test_moving_average_and_slope(spark):
    quantities = [10.0, 20.0, 30.0, 40.0, 50.0, 0.0, 60.0, 70.0, 80.0, 5.0]
    rows = [("s", "d", f"w{i:02d}", q) for i, q in enumerate(quantities)]
    frame = spark.createDataFrame(rows, "sku_id string, district string, week string, actual_qty double")
    got = frame.transform(windows.moving_average).transform(windows.trend_slope).orderBy("week").collect()
    assert [r["ma_4w"] for r in got[:5]] == [10.0, 15.0, 20.0, 25.0, 35.0]
    assert [r["trend_slope"] for r in got] == [0.0, 0.0, 0.0, 0.0, 10.0, -5.0, 7.5, 7.5, 7.5, 0.0]


def test_demand_series_merges_retailers_and_renamed_skus(spark):
    rows = [("s", "old", "d", "st", "w1", "r1", 1.5), ("s", "new", "d", "st", "w1", "r2", 2.25), ("s", "old", "d", "st", "w2", "r1", 1.0)]
    frame = spark.createDataFrame(
        rows, "sku_id string, sku_name string, district string, state string, week string, retailer_id string, actual_qty double"
    )
    got = {r["week"]: (r["actual_qty"], r["sku_name"]) for r in gold.demand_series(frame).collect()}
    assert got == {"w1": (3.75, "old"), "w2": (1.0, "old")}


def test_forecast_flags_demand_when_no_stock_is_known(spark):
    rows = [("s", "d", "st", f"w{i}", 10.0 * i) for i in range(6)]
    frame = spark.createDataFrame(rows, "sku_id string, district string, state string, week string, actual_qty double")
    with pytest.warns(UserWarning, match="current_stock_qty"):
        got = gold.demand_forecast(frame).orderBy("week").collect()
    assert [r["stockout_risk_flag"] for r in got] == [0, 1, 1, 1, 1, 1]
    assert "sku_name" not in got[0].asDict()


def test_anomalies(spark):
    rows = [("s1", "d", "w1", "SPIKE", 1), ("s2", "d", "w1", "STABLE", 1), ("s3", "d", "w1", "STABLE", 1),
            ("s4", "d", "w2", "STABLE", 1), ("s5", "d", "w2", "GROWING", 1)]
    frame = spark.createDataFrame(
        rows, "sku_id string, district string, week string, demand_category string, stockout_risk_flag int"
    )
    got = sorted(((r["kind"], r["week"], r["sku_id"] or "", r["sku_count"]) for r in gold.anomalies(frame).collect()))
    assert got == [("demand_spike", "w1", "s1", 1), ("stockout_cluster", "w1", "", 3)]


def test_dense_key_numbers_in_order_over_many_partitions(spark):
    frame = spark.range(5000).select(F.format_string("s%02d", F.col("id") % 7).alias("state"), F.format_string("d%05d", "id").alias("district"))
    keyed = dense_key(frame.repartition(6), ["state", "district"], "key")
    rows = [(r["state"], r["district"]) for r in keyed.orderBy("key").collect()]
    assert rows == sorted(rows)
    assert [r["key"] for r in keyed.orderBy("key").select("key").collect()] == list(range(1, 5001))
