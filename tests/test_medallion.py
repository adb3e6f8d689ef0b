import json

import pytest
from pyspark.sql import functions as F

from fieldmart import schemas
from fieldmart.operators import dq, metrics
from fieldmart.plans import bronze, medallion, reports, silver
from fieldmart.sources import csv
from samples import DISTRICT_SCHEMA, DISTRICTS, RETAILER_SCHEMA, RETAILERS


def write_csv(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [",".join(header)] + [",".join("" if v is None else str(v) for v in row) for row in rows]
    (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


def names(schema):
    return [part.split()[0] for part in schema.split(",")]


@pytest.fixture()
def raw(tmp_path):
    root = tmp_path / "raw"
    write_csv(root / "retailers", "features_retailers", names(RETAILER_SCHEMA), RETAILERS)
    write_csv(root / "risk" / "daily", "features_district_risk", names(DISTRICT_SCHEMA), DISTRICTS)
    inventory = [("K11", "S1", "Seed", 5.0, "2026-05-17"), ("K11", "S1", "Seed", 5.0, "2026-05-17"),
                 ("K12", "S1", "Seed", 7.0, "2026-05-17"), ("K99", "S1", "Seed", 9.0, "2026-05-17")]
    write_csv(root / "stock", "retailer_inventory_weekly", schemas.RAW_INVENTORY.fieldNames(), inventory)
    (root / "notes.txt").write_text("not a table")
    return str(root)


def test_discovery_lists_only_csv_files_by_stem(spark, raw):
    found = {r["dataset"]: r["size"] for r in csv.discover(spark, raw).collect()}
    assert set(found) == {"features_retailers", "features_district_risk", "retailer_inventory_weekly"}
    assert all(size > 0 for size in found.values())


def test_discovery_names_exports_after_their_folder(spark, tmp_path):
    spark.range(10).repartition(3).write.option("header", True).csv(str(tmp_path / "raw" / "numbers"))
    assert {r["dataset"] for r in csv.discover(spark, str(tmp_path / "raw"), ["numbers"]).collect()} == {"numbers"}
    rows = bronze.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), exported=["numbers"])
    assert rows == {"numbers": 10}  # no schema known: types are inferred
    assert dict(spark.read.parquet(str(tmp_path / "bronze" / "numbers")).dtypes)["id"] == "int"


def test_plain_files_and_exports_of_one_dataset_are_read_together(spark, tmp_path):
    header = names(RETAILER_SCHEMA)
    write_csv(tmp_path / "raw", "features_retailers", header, [RETAILERS[0]])
    write_csv(tmp_path / "raw" / "features_retailers", "part-0", header, [RETAILERS[1]])
    write_csv(tmp_path / "raw" / "misc", "part-numbers", ["n"], [(1,), (2,)])
    write_csv(tmp_path / "raw", "sales[2024]", ["n"], [(3,)])
    rows = bronze.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"))
    assert rows == {"features_retailers": 2, "part-numbers": 2, "sales[2024]": 1}


def test_headers_are_matched_by_name(spark, tmp_path):
    header = names(RETAILER_SCHEMA)
    alias = [("weeks_of_stock_remaining" if c == "weeks_of_stock" else c) for c in header]
    write_csv(tmp_path / "raw" / "a", "features_retailers", alias, [RETAILERS[0]])
    write_csv(tmp_path / "raw" / "b", "features_retailers", header[::-1], [RETAILERS[1][::-1]])
    write_csv(tmp_path / "raw" / "c", "features_retailers", [*header, "note"], [(*RETAILERS[2], "new")])
    write_csv(tmp_path / "raw" / "d", "features_retailers", header[:-1], [RETAILERS[3][:-1]])
    bronze.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"))
    frame = spark.read.parquet(str(tmp_path / "bronze" / "features_retailers"))
    rows = {r["retailer_id"]: r for r in frame.collect()}
    assert [rows[k]["weeks_of_stock"] for k in ("K11", "K12", "K13", "K14")] == [6.5, 1.5, 2.0, None]
    assert rows["K13"]["note"] == "new" and rows["K11"]["note"] is None
    assert all(r[csv.CORRUPT_RECORD] is None for r in rows.values())


def test_files_of_one_stem_in_two_folders_are_one_dataset(spark, tmp_path):
    for folder, row in (("north", RETAILERS[0]), ("south", RETAILERS[1])):
        write_csv(tmp_path / "raw" / folder, "features_retailers", names(RETAILER_SCHEMA), [row])
    assert bronze.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze")) == {"features_retailers": 2}


def test_bad_text_is_kept_aside_and_becomes_null(spark, tmp_path):
    header = names(RETAILER_SCHEMA)
    bad = list(RETAILERS[1])
    bad[6] = "n/a"
    write_csv(tmp_path / "raw", "features_retailers", header, [RETAILERS[0], bad])
    bronze.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"))
    rows = {r["retailer_id"]: r for r in spark.read.parquet(str(tmp_path / "bronze" / "features_retailers")).collect()}
    assert rows["K11"][csv.CORRUPT_RECORD] is None and rows["K11"]["avg_weekly_revenue"] == 60000.0
    assert "n/a" in rows["K12"][csv.CORRUPT_RECORD] and rows["K12"]["avg_weekly_revenue"] is None
    assert rows["K12"]["stockout_events"] == 4


def test_ingest_metadata(spark, raw, tmp_path):
    moment = F.lit("2026-05-20 02:00:00").cast("timestamp")
    bronze.ingest(spark, raw, str(tmp_path / "bronze"), ingested_at=moment)
    frame = spark.read.parquet(str(tmp_path / "bronze" / "features_retailers"))
    row = frame.first()
    assert frame.count() == 6 and str(row["ingestion_date"]) == "2026-05-20"
    assert row["source_path"].endswith("retailers/features_retailers.csv")


def test_whole_run(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    rows = medallion.run(spark, raw, lake, "s3_event", run_id="r1")
    assert rows["bronze"] == {"features_district_risk": 5, "features_retailers": 6, "retailer_inventory_weekly": 4}
    assert rows["silver"] == {"retailer": 5, "district": 5, "demand": 2}  # unknown retailer and duplicates drop out
    assert rows["gold"] == {"retailer_kpi": 5, "district_risk": 5, "demand_forecast": 2}

    kpi = spark.read.parquet(f"{lake}/gold/retailer_kpi")
    assert kpi.filter("rps_score is null or rps_score < 0 or rps_score > 1").count() == 0
    assert reports.urgent_retailers(kpi).count() == 2  # the newest day by default

    documents = spark.read.json(f"{lake}/dq_reports/run_id=r1")
    failed = {(r["table"], r["rule"]) for r in dq.failed_rules(documents).collect()}
    assert failed == {
        ("retailer", "UNIQUE(retailer_id, week)"), ("retailer", "MIN_ROWS(10)"),
        ("demand", "UNIQUE(sku_id, district, retailer_id, week)"),
    }
    entry = medallion.run_log(spark, lake).first()
    assert (entry["status"], entry["rows_bronze"], entry["rows_silver"], entry["rows_gold"]) == ("SUCCESS", 15, 12, 12)
    assert entry["dq_failures"] == 3 and entry["triggered_by"] == "s3_event"


def test_freshness_and_referential_rules_join_the_suites(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    master = spark.createDataFrame([("Velm",), ("Sorra",), ("Quill",), ("Brask",)], "district string")
    medallion.run(spark, raw, lake, run_id="r1", max_age_hours=48, district_master=master)
    rules = {
        (r["table"], r["rule"]): r["fail_count"]
        for r in spark.read.json(f"{lake}/dq_reports/run_id=r1").selectExpr("table", "inline(rules)").collect()
    }
    assert rules["retailer", "FRESHNESS(ingestion_timestamp, 48h)"] == 0
    assert rules["retailer", "REFERENTIAL(district)"] == 1 and rules["district", "REFERENTIAL(district)"] == 1
    assert rules["demand", "REFERENTIAL(district)"] == 0
    assert len(rules) == 16


def test_a_second_run_keeps_one_row_per_key(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    medallion.run(spark, raw, lake)
    rows = medallion.run(spark, raw, lake)
    assert rows["silver"]["retailer"] == 5 and medallion.run_log(spark, lake).count() == 2
    assert spark.read.parquet(f"{lake}/silver/retailer").count() == 5


def test_a_row_delivered_again_on_a_later_day_moves_there(spark, tmp_path):
    for day, row in (("2026-05-20", RETAILERS[0]), ("2026-05-21", RETAILERS[0][:6] + (1.0,) + RETAILERS[0][7:])):
        write_csv(tmp_path / "raw", "features_retailers", names(RETAILER_SCHEMA), [row])
        bronze.ingest(
            spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), ingested_at=F.lit(f"{day} 02:00:00").cast("timestamp")
        )
        silver.refine(spark, str(tmp_path / "bronze"), str(tmp_path / "silver"), str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "bronze" / "features_retailers")).count() == 2
    rows = spark.read.parquet(str(tmp_path / "silver" / "retailer")).collect()
    assert [(str(r["ingestion_date"]), r["avg_weekly_revenue"]) for r in rows] == [("2026-05-21", 1.0)]


def test_daily_merges_equal_a_full_rebuild(spark, tmp_path):
    """Rows that return on later days, a day that empties, and one that is untouched."""
    base = RETAILERS[0]

    def row(key, week, revenue):
        return (key, *base[1:5], week, revenue, *base[7:])

    days = {
        "2026-05-18": [row("A", "2026-W20", 1.0)],
        "2026-05-19": [row("A", "2026-W20", 2.0), row("B", "2026-W20", 1.0)],
        "2026-05-20": [row("C", "2026-W20", 1.0), row("C", "2026-W20", 5.0)],
        "2026-05-21": [row("B", "2026-W20", 3.0), row("D", "2026-W21", 1.0)],
    }
    raw, bronze_dir = tmp_path / "raw", str(tmp_path / "bronze")
    merged, rebuilt = str(tmp_path / "merged"), str(tmp_path / "rebuilt")
    for day, rows in days.items():
        write_csv(raw, "features_retailers", names(RETAILER_SCHEMA), rows)
        bronze.ingest(spark, str(raw), bronze_dir, ingested_at=F.lit(f"{day} 02:00:00").cast("timestamp"))
        for _ in range(2):  # a repeated day changes nothing
            silver.refine(spark, bronze_dir, merged, str(tmp_path / "reports"), day=day)
    untouched = {p: p.stat().st_mtime for p in (tmp_path / "merged/retailer/ingestion_date=2026-05-20").iterdir()}
    silver.refine(spark, bronze_dir, merged, str(tmp_path / "reports"), day="2026-05-21")
    silver.refine(spark, bronze_dir, rebuilt, str(tmp_path / "reports"))

    def table(path):
        frame = spark.read.parquet(f"{path}/retailer")
        return sorted(map(str, frame.select(*names(RETAILER_SCHEMA), "ingestion_date").collect()))

    assert table(merged) == table(rebuilt) and len(table(merged)) == 4
    assert not (tmp_path / "merged/retailer/ingestion_date=2026-05-18").exists()
    assert untouched == {p: p.stat().st_mtime for p in (tmp_path / "merged/retailer/ingestion_date=2026-05-20").iterdir()}


def test_missing_inputs_are_skipped(spark, tmp_path):
    write_csv(tmp_path / "raw", "features_district_risk", names(DISTRICT_SCHEMA), DISTRICTS)
    rows = medallion.run(spark, str(tmp_path / "raw"), str(tmp_path / "lake"))
    assert rows["silver"] == {"district": 5} and rows["gold"] == {"district_risk": 5}


def test_a_failed_run_is_logged_and_raised(spark, tmp_path):
    lake = str(tmp_path / "lake")
    with pytest.raises(Exception):
        medallion.run(spark, str(tmp_path / "absent"), lake)
    assert medallion.run_log(spark, lake).first()["status"] == "FAILED"


def test_enrichment_does_not_multiply_rows(spark):
    retailers = spark.createDataFrame(
        [("R1", "d_old", "s", "2024-01-01"), ("R1", "d_new", "s", "2024-01-02")],
        "retailer_id string, district string, state string, ingestion_timestamp string",
    )
    stock = spark.createDataFrame([("R1", "S", "x")], "retailer_id string, sku_id string, district string")
    assert [r["district"] for r in silver.enrich_inventory(stock, retailers).collect()] == ["d_new"]


def test_valid_rows(spark):
    frame = spark.createDataFrame([("a", 0.0), ("b", -1.0), ("c", None), (None, 5.0)], "retailer_id string, avg_weekly_revenue double")
    assert [r["retailer_id"] for r in silver.valid_retailers(frame).collect()] == ["a"]


def test_arrival_events(spark):
    event = {"Records": [
        {"s3": {"bucket": {"name": "b"}, "object": {"key": "raw/a.csv", "size": 7}}},
        {"s3": {"bucket": {"name": "b"}, "object": {"key": "raw/b.csv"}}},
        {"s3": {"bucket": {"name": "b"}, "object": {"key": "raw/c.json", "size": 1}}},
        {"s3": {"bucket": {"name": "b"}, "object": {"key": "other/d.csv", "size": 1}}},
    ]}
    frame = spark.createDataFrame([(1, json.dumps(event)), (2, "{}"), (3, '{"Records": []}')], "id int, event string")
    files = metrics.arrivals(frame)
    assert files.count() == 4
    assert sorted((r["key"], r["size"]) for r in metrics.triggering(files).collect()) == [("raw/a.csv", 7), ("raw/b.csv", 0)]


def test_silver_of_one_bronze_day_is_written_without_a_gathering_shuffle(spark, raw, tmp_path, monkeypatch):
    gathered, write = [], silver.write_partitioned

    def spy(*args, gather=True, **kwargs):
        gathered.append(gather)
        return write(*args, gather=gather, **kwargs)

    monkeypatch.setattr(silver, "write_partitioned", spy)
    lake = str(tmp_path / "lake")
    bronze.ingest(spark, raw, f"{lake}/bronze")
    one = silver.refine(spark, f"{lake}/bronze", f"{lake}/silver", f"{lake}/reports")
    assert gathered == [False, False, False] and one == {"retailer": 5, "district": 5, "demand": 2}
    bronze.ingest(spark, raw, f"{lake}/bronze", ingested_at=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert silver.refine(spark, f"{lake}/bronze", f"{lake}/silver", f"{lake}/reports2") == one
    assert gathered[3:] == [True, True, True]
