"""Partial Gold runs against a rebuild from the same Silver table."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmart.plans import gold, partial_gold, silver
from fieldmart.sources import files, lake

SILVER = (
    "retailer_id string, retailer_name string, state string, district string, tehsil string, week string, "
    "avg_weekly_revenue double, revenue_tier string, days_since_last_visit int, stockout_events int, "
    "avg_depletion_rate double, weeks_of_stock double, stockout_risk_flag int, ingestion_date string, at int"
)


def frame(spark, rows):
    return (
        spark.createDataFrame(rows, SILVER)
        .withColumn("ingestion_date", F.col("ingestion_date").cast("date"))
        .withColumn("ingestion_timestamp", F.timestamp_seconds("at"))
        .drop("at")
    )


def row(retailer, week, revenue, day, tehsil="t1", state="A/B %", at=0, visit=5, stock=3.0):
    return (retailer, "n", state, "d", tehsil, week, revenue, "LOW", visit, 2, 4.0, stock, int(stock < 2), day, at)


# Holds every extreme, so other rows can come and go without moving a score.
ENDS = [row("lo", "w1", 0.0, "2031-01-01", "ends", visit=0), row("hi", "w1", 1000.0, "2031-01-01", "ends", visit=50)]


class Lake:
    def __init__(self, spark, root):
        self.spark, self.paths = spark, [f"{root}/{n}" for n in ("silver", "gold", "state")]

    def deliver(self, *rows):
        silver.merge_newest(self.spark, frame(self.spark, list(rows)), self.paths[0], silver.RETAILER_KEYS)
        return self.refresh()

    def refresh(self):
        return partial_gold.refresh(self.spark, partial_gold.RETAILER_KPI, *self.paths)

    def gold(self):
        return lake.read_optional(self.spark, self.paths[1])

    def assert_equals_rebuild(self):
        whole = gold.retailer_kpi(lake.read_optional(self.spark, self.paths[0]))
        assert sorted(whole.columns) == sorted(self.gold().columns)
        got = sorted(map(repr, self.gold().select(*whole.columns).collect()))
        assert got == sorted(map(repr, whole.collect()))

    def folders(self):
        return {r[0]: r[1] for r in self.gold().groupBy(
            F.concat_ws("|", "state", "ingestion_date")).agg(F.concat_ws(",", F.sort_array(F.collect_set(
                F.element_at(F.split("_metadata.file_path", "/"), -1))))).collect()}


@pytest.fixture
def shop(spark, tmp_path):
    return Lake(spark, tmp_path)


def test_only_partitions_with_changed_values_are_replaced(shop):
    first = [row("a", "w1", 10.0, "2031-01-01"), row("a", "w3", 20.0, "2031-01-03"), row("b", "w3", 30.0, "2031-01-03", "t2", "C")]
    assert shop.deliver(*ENDS, *first)["mode"] == "full"
    before = shop.folders()
    # Week 2 arrives after week 3, whose change of revenue now has another base.
    assert shop.deliver(row("a", "w2", 40.0, "2031-01-02"))["mode"] == "partial"
    shop.assert_equals_rebuild()
    after = shop.folders()
    assert {k for k in before if after[k] != before[k]} == {"A/B %|2031-01-03"}
    assert [r["revenue_wow_pct"] for r in shop.gold().filter("retailer_id = 'a' AND week = 'w3'").collect()] == [-50.0]
    assert shop.refresh() == {"mode": "unchanged", "rows": 0} and shop.folders() == after


def test_a_row_of_a_tehsil_pushes_another_out_of_the_best_five(shop):
    rows = [row(f"r{i}", "w1", 100.0 + i, f"2031-01-0{i}", visit=10) for i in range(1, 6)]
    shop.deliver(*ENDS, *rows)
    assert shop.gold().filter("tehsil = 't1' AND top5_in_tehsil = 1").count() == 5
    assert shop.deliver(row("new", "w1", 900.0, "2031-01-09", state="C"))["mode"] == "partial"
    shop.assert_equals_rebuild()
    assert [r["retailer_id"] for r in shop.gold().filter("tehsil = 't1' AND top5_in_tehsil = 0").collect()] == ["r1"]


def test_moved_rows_leave_no_partition_behind_and_moved_extremes_rebuild(shop):
    shop.deliver(*ENDS, row("a", "w1", 10.0, "2031-01-02"), row(None, "w1", 11.0, "2031-01-02", None, None))
    assert shop.deliver(row("a", "w1", 12.0, "2031-01-03", at=5), row(None, "w1", 13.0, "2031-01-03", None, "D", at=5))["mode"] == "partial"
    shop.assert_equals_rebuild()
    assert not any("2031-01-02" in key for key in shop.folders())
    assert not files.subfolders(shop.spark, f"{shop.paths[1]}/state={lake.NULL_PARTITION}")
    # The greatest revenue is corrected downwards: every score moves.
    assert shop.deliver(row("hi", "w1", 500.0, "2031-01-03", "ends", at=9, visit=50))["mode"] == "full"
    shop.assert_equals_rebuild()


def test_a_run_that_ended_half_way_is_followed_by_a_rebuild(shop, monkeypatch):
    shop.deliver(*ENDS, row("a", "w1", 10.0, "2031-01-01"), row("a", "w3", 20.0, "2031-01-03"))
    with monkeypatch.context() as patch:
        def lost(*_):
            raise RuntimeError("lost")

        patch.setattr(partial_gold, "_drop_partitions", lost)
        with pytest.raises(RuntimeError):
            shop.deliver(row("a", "w2", 40.0, "2031-01-02"))
    assert shop.refresh()["mode"] == "full"
    shop.assert_equals_rebuild()


def test_random_deliveries_equal_rebuilds(shop):
    draw, modes = random.Random(3), set()
    shop.deliver(*ENDS, *[row(f"r{i}", "w0", 1.0 * i, "2031-01-01", f"t{i % 3}") for i in range(20)])
    for step in range(2):
        rows = {}
        for _ in range(12):
            key = (f"r{draw.randrange(20)}", f"w{draw.randrange(4)}")
            rows[key] = row(*key, draw.choice([5.0, 50.0, 500.0]), f"2031-01-0{draw.randrange(1, 9)}", f"t{draw.randrange(3)}",
                            draw.choice(["A/B %", "C", None]), at=step + 1, visit=draw.randrange(50))
        modes.add(shop.deliver(*rows.values())["mode"])
        shop.assert_equals_rebuild()
    assert modes == {"partial"}


def test_district_windows(spark, tmp_path):
    columns = "district string, state string, date string, total_pest_alerts int, fungicide_risk_flag int, drought_stress_flag int, high_humidity_flag int, high_incidence_count int"

    def days(*rows):
        out = spark.createDataFrame([(d, "S", f"2031-01-{n:02d}", pest, n % 2, 0, 1, n) for d, n, pest in rows], columns)
        return out.withColumn("ingestion_date", F.col("date").cast("date")).withColumn("ingestion_timestamp", F.col("date").cast("timestamp"))

    paths = [str(tmp_path / n) for n in ("silver", "gold", "state")]
    modes = []
    for part in (days(*[("x", n, 2 * n) for n in range(1, 20) if n != 9], ("y", 1, 99)), days(("x", 9, 60))):
        silver.merge_newest(spark, part, paths[0], silver.DISTRICT_KEYS)
        modes.append(partial_gold.refresh(spark, partial_gold.DISTRICT_RISK, *paths))
    whole = gold.district_risk(lake.read_optional(spark, paths[0]))
    got = lake.read_optional(spark, paths[1]).select(*whole.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert modes[1]["mode"] == "partial" and 2 <= modes[1]["rows"] <= 7
