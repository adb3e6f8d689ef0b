"""Runs that build on earlier ones: ingest log, ordered upserts, loads with rejects, stable keys."""

import os

import pytest
from pyspark.sql import functions as F

from fieldmart import schemas
from fieldmart.functions.numeric import exact_avg, exact_sum
from fieldmart.operators import keys
from fieldmart.operators.upsert import upsert_latest
from fieldmart.plans import bronze, mart, medallion
from fieldmart.sources import csv, files, lake, ledger
from fieldmart.streaming import jobs
from samples import DISTRICT_SCHEMA, DISTRICTS, RETAILER_SCHEMA, RETAILERS
from test_medallion import names, write_csv

LEDGER = schemas.schema_of("name string, n int")


def entry(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


# ---- ledger ------------------------------------------------------------------------------


def test_ledger_appends_whole_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    assert ledger.read(spark, path, LEDGER).count() == 0 and ledger.entries(spark, path) == set()
    one = ledger.append(entry(spark, ("a", 1), ("b", 2)), path, "b1")
    ledger.append(entry(spark), path)  # a commit without rows
    # Rows that were never committed are not seen.
    entry(spark, ("z", 9)).write.parquet(f"{path}/entries/entry=lost")
    ledger.append(entry(spark, ("c", 3)), path, "b3")
    assert sorted(r["name"] for r in ledger.read(spark, path, LEDGER).collect()) == ["a", "b", "c"]
    assert [r["name"] for r in ledger.read(spark, path, LEDGER, since=1).collect()] == ["c"]
    assert one == "b1" and list(ledger.commits(spark, path)) == [1, 2, 3]


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "claim")
    assert files.create(spark, path, "first") and not files.create(spark, path, "second")
    assert files.read_text(spark, path) == "first"
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["claim"]


def test_a_writer_that_was_overtaken_checks_and_goes_on(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "log"), []
    ledger.append(entry(spark, ("a", 1)), path, "b1")
    real, calls = ledger.commits, []

    def stale(session, where):
        calls.append(1)
        return {} if len(calls) == 1 else real(session, where)

    monkeypatch.setattr(ledger, "commits", stale)
    ledger.append(entry(spark, ("b", 2)), path, "b2", seen.append)
    monkeypatch.setattr(ledger, "commits", real)
    assert seen == [0] and ledger.entries(spark, path) == {"b1", "b2"}


# ---- incremental Bronze ------------------------------------------------------------------


def retailer_rows(spark, path):
    frame = bronze.read_bronze(spark, path, "features_retailers")
    return sorted(tuple(r) for r in frame.select(*schemas.RAW_RETAILERS.fieldNames()).collect())


def test_daily_runs_equal_one_rebuild_and_read_new_files_only(spark, tmp_path, monkeypatch):
    raw, target, whole = tmp_path / "raw", str(tmp_path / "bronze"), str(tmp_path / "whole")
    opened = []
    real = files.first_records
    monkeypatch.setattr(files, "first_records", lambda s, paths, *a: opened.append(sorted(os.path.basename(os.path.dirname(p)) for p in paths)) or real(s, paths, *a))
    counts = []
    for day in range(3):
        write_csv(raw / f"day{day}", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[2 * day : 2 * day + 2])
        counts.append(bronze.ingest_new(spark, str(raw), target))
    assert counts == [{"features_retailers": 2}] * 3 and opened == [["day0"], ["day1"], ["day2"]]
    assert bronze.ingest_new(spark, str(raw), target) == {}
    bronze.ingest(spark, str(raw), whole)
    assert retailer_rows(spark, target) == retailer_rows(spark, whole) and len(retailer_rows(spark, whole)) == 6


def test_rows_of_a_run_that_never_committed_are_not_read(spark, tmp_path, monkeypatch):
    raw, target = tmp_path / "raw", str(tmp_path / "bronze")
    write_csv(raw / "a", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[:2])
    bronze.ingest_new(spark, str(raw), target)
    write_csv(raw / "b", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[2:4])
    real = ledger.append

    def ended(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(ledger, "append", ended)
    with pytest.raises(KeyboardInterrupt):  # the driver goes between data and log
        bronze.ingest_new(spark, str(raw), target)
    monkeypatch.setattr(ledger, "append", real)
    assert len(retailer_rows(spark, target)) == 2
    assert bronze.ingest_new(spark, str(raw), target) == {"features_retailers": 2}
    assert len(retailer_rows(spark, target)) == 4


def test_of_two_runs_on_the_same_files_one_counts(spark, tmp_path, monkeypatch):
    raw, target = tmp_path / "raw", str(tmp_path / "bronze")
    write_csv(raw, "features_retailers", names(RETAILER_SCHEMA), RETAILERS[:3])
    real = ledger.append

    def overtaken(rows, path, name, check):
        monkeypatch.setattr(ledger, "append", real)
        bronze.ingest_new(spark, str(raw), target)  # another run commits first
        check(0)

    monkeypatch.setattr(ledger, "append", overtaken)
    with pytest.raises(ledger.Conflict, match="1 of the files"):
        bronze.ingest_new(spark, str(raw), target)
    assert len(retailer_rows(spark, target)) == 3
    folders = [n for day in os.listdir(f"{target}/features_retailers") if day.startswith("ingestion_date=") for n in os.listdir(f"{target}/features_retailers/{day}") if n.startswith(bronze.BATCH)]
    assert len(folders) == 1


def test_incremental_run_of_the_whole_lake(spark, tmp_path):
    raw, target = tmp_path / "raw", str(tmp_path / "lake")
    for day in range(2):
        write_csv(raw / str(day), "features_retailers", names(RETAILER_SCHEMA), RETAILERS[3 * day : 3 * day + 3])
        write_csv(raw / str(day), "features_district_risk", names(DISTRICT_SCHEMA), DISTRICTS)
        counts = medallion.run(spark, str(raw), target, incremental=True)
    assert counts["bronze"] == {"features_district_risk": len(DISTRICTS), "features_retailers": 3}
    assert counts["silver"]["retailer"] == len({(r[0], r[names(RETAILER_SCHEMA).index("week")]) for r in RETAILERS[:6]})
    assert bronze.BATCH not in spark.read.parquet(f"{target}/silver/retailer").columns


@pytest.mark.parametrize(
    ("header", "want"),
    [
        (["A", " b "], ["a", "b"]),
        (["x", "X", "x"], ["x", "X_1", "x_2"]),
        (["old", "b"], ["a", "b"]),
        (["old", "A"], ["old", "a"]),
        (["", "a"], ["_c0", "a"]),
        (["a_1", "a", "a"], ["a_1", "a", "a_2"]),
    ],
)
def test_column_names(header, want):
    assert csv.column_names(header, ["a", "b"], {"old": "a"}) == want


def test_awkward_headers_do_not_fail_an_ingest(spark, tmp_path):
    raw, target = tmp_path / "raw" / "features_retailers", str(tmp_path / "bronze")
    raw.mkdir(parents=True)
    (raw / "1.csv").write_text("Retailer_ID, district,note,note\nr1,d1,x,y\n")
    (raw / "2.csv").write_text("week,retailer_id,weeks_of_stock_remaining\n2024-W01,r2,1.5\n")
    (raw / "3.csv").write_text("")
    assert bronze.ingest_new(spark, str(tmp_path / "raw"), target) == {"features_retailers": 2}
    got = {r["retailer_id"]: r for r in bronze.read_bronze(spark, target, "features_retailers").collect()}
    assert (got["r1"]["district"], got["r1"]["note"], got["r1"]["note_3"], got["r2"]["weeks_of_stock"]) == ("d1", "x", "y", 1.5)


# ---- streams -----------------------------------------------------------------------------


def test_one_stream_feeds_the_tables_of_all_datasets(spark, tmp_path):
    landing, target, offsets = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "offsets")

    def run():
        jobs.ingest_routed(spark, str(landing), target, offsets).awaitTermination()
        return [f.count() if (f := bronze.read_bronze(spark, target, d)) is not None else 0 for d in ("features_retailers", "features_district_risk")]

    write_csv(landing / "a", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[:4])
    assert run() == [4, 0]
    write_csv(landing / "b", "features_retailers", list(reversed(names(RETAILER_SCHEMA))), [tuple(reversed(r)) for r in RETAILERS[4:6]])
    write_csv(landing / "b", "features_district_risk", names(DISTRICT_SCHEMA), DISTRICTS)
    assert run() == [6, len(DISTRICTS)] and run() == [6, len(DISTRICTS)]
    assert len(retailer_rows(spark, target)) == 6


ORDERED = "retailer_id string, week string, v string, ts int"


def test_an_older_row_never_replaces_a_newer_one(spark):
    target = spark.createDataFrame([("a", "w", "new", 10), ("b", "w", "old", 1), (None, "w", "keyless", 1), ("c", "w", "dated", 1)], ORDERED)
    staged = spark.createDataFrame([("a", "w", "late", 5), ("b", "w", "tie", 1), ("d", "w", "x", 1), ("d", "w", "y", 2), (None, "w", "more", 0), ("c", "w", "undated", None)], ORDERED)
    got = sorted((r["retailer_id"] or "", r["v"]) for r in upsert_latest(target, staged, ["retailer_id", "week"], "ts").collect())
    assert got == [("", "keyless"), ("", "more"), ("a", "new"), ("b", "tie"), ("c", "dated"), ("d", "y")]


@pytest.mark.parametrize("partition_by", ["week", None])
def test_stream_upsert_over_batches_out_of_order(spark, tmp_path, partition_by):
    landing, path, offsets = str(tmp_path / "landing"), str(tmp_path / "fact"), str(tmp_path / "offsets")
    read = lambda: spark.read.schema(ORDERED).parquet(path) if partition_by else lake.read_version(spark, path)
    for rows in ([("a", "w1", "new", 10), ("b", "w2", "kept", 1)], [("a", "w1", "late", 5)], [("c", "w1", "x", 1)], [("c", "w1", "z", 3)], []):
        spark.createDataFrame(rows, ORDERED).write.mode("append").parquet(landing)
        jobs.upsert_into(jobs.read_files(spark, landing, read_schema(spark)), path, ["retailer_id", "week"], "ts", offsets, partition_by=partition_by).awaitTermination()
    assert sorted((r["retailer_id"], r["v"]) for r in read().collect()) == [("a", "new"), ("b", "kept"), ("c", "z")]
    if not partition_by:
        assert len(list(lake.versions(spark, path))) <= 3


def read_schema(spark):
    return spark.createDataFrame([], ORDERED).schema


def test_a_batch_delivered_again_is_skipped(spark, tmp_path):
    path = str(tmp_path / "fact")
    merge = jobs._merge_batch(path, ["retailer_id", "week"], "ts", "week", "s", 3)
    batch = spark.createDataFrame([("a", "w1", "x", 1), (None, "w1", "keyless", 1)], ORDERED)
    for _ in range(2):
        merge(batch, 7)
    assert spark.read.schema(ORDERED).parquet(path).count() == 2
    merge(batch, 8)
    assert spark.read.schema(ORDERED).parquet(path).count() == 3


# ---- loads -------------------------------------------------------------------------------

GOLD = "retailer_id string, state string, district string, week string, stockout_events bigint, weeks_of_stock double, rps_score double, ingestion_date date"


def gold(spark, rows):
    return spark.createDataFrame(rows, GOLD.replace(" date", " string")).withColumn("ingestion_date", F.to_date("ingestion_date"))


def test_loads_and_rejects_make_up_the_input(spark, tmp_path):
    path = str(tmp_path / "mart")
    rows = [
        ("a", "s", "d", "2024-W01", 3, 1.5, 0.5, "2024-01-01"), ("b", "s", "d", "2024-W01", 5_000_000_000, 1.5, 0.5, "2024-01-01"),
        ("c", "s", "d", "2024-W01", 1, 12345.5, 0.5, "2024-01-01"), ("d", "s", None, "2024-W01-too-long", None, None, float("nan"), "2024-01-02"),
        ("e", "s", "d", "2024-W01", None, None, float("nan"), "2024-01-03"),
    ]
    for _ in range(2):  # a load made again leaves the same rows
        assert mart.load_fact(spark, gold(spark, rows), "retailer_kpi", path) == {"read": 5, "loaded": 2, "rejected": 3}
        good = {r["retailer_id"]: r for r in spark.read.parquet(f"{path}/retailer_kpi").collect()}
        bad = {r["retailer_id"]: r for r in spark.read.parquet(f"{path}/rejects/retailer_kpi").collect()}
        assert set(good) == {"a", "e"} and good["e"]["stockout_events"] == 0 and good["e"]["rps_score"] is None
        assert {k: list(r["reasons"]) for k, r in bad.items()} == {
            "b": ["stockout_events does not fit int: 5000000000"], "c": ["weeks_of_stock does not fit decimal(6,2): 12345.5"],
            "d": ["district is null", "week is longer than 10"],
        }
        assert bad["b"]["stockout_events"] is None
    # The day's rows are mended: its rejects go.
    fixed = [("b", "s", "d", "2024-W01", 5, 1.5, 0.5, "2024-01-01"), ("d", "s", "d", "2024-W01", None, None, None, "2024-01-02")]
    assert mart.load_fact(spark, gold(spark, fixed), "retailer_kpi", path)["rejected"] == 0
    assert lake.read_optional(spark, f"{path}/rejects/retailer_kpi").count() == 0
    assert sorted(r["retailer_id"] for r in spark.read.parquet(f"{path}/retailer_kpi").collect()) == ["b", "d", "e"]
    assert mart.load_fact(spark, gold(spark, []), "retailer_kpi", path) == {"read": 0, "loaded": 0, "rejected": 0}


def test_sums_fail_rather_than_lose_a_value(spark):
    fine = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (9e17,)], "v double")
    assert [tuple(r) for r in fine.select(exact_sum(F.col("v")), exact_avg(F.col("v"))).collect()] == [(9e17 + 1, (9e17 + 1) / 2)]
    with pytest.raises(Exception, match="out of range for an exact sum"):
        fine.union(spark.createDataFrame([(2e18,)], "v double")).select(exact_sum(F.col("v"))).collect()


# ---- keys --------------------------------------------------------------------------------


def test_keys_once_given_stay(spark):
    first = keys.stable_key(None, spark.createDataFrame([("b",), ("d",), ("d",)], "k string"), ["k"], "id")
    second = keys.stable_key(first, spark.createDataFrame([("a",), ("d",), (None,), (None,), ("c",)], "k string"), ["k"], "id")
    assert {r["k"]: r["id"] for r in first.collect()} == {"b": 1, "d": 2}
    got = {r["k"]: r["id"] for r in second.collect()}
    assert (got["b"], got["d"]) == (1, 2) and sorted(got.values()) == [1, 2, 3, 4, 5]
    third = keys.stable_key(second, spark.createDataFrame([(None,), ("c",)], "k string"), ["k"], "id")
    assert {r["k"]: r["id"] for r in third.collect()} == got


def test_district_dimension_over_loads(spark, tmp_path):
    path, moment = str(tmp_path / "dim"), lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    load = lambda rows, d: mart.maintain_districts(spark, spark.createDataFrame(rows, "state string, district string, region string"), path, moment(d))
    load([("s", "m", "north"), ("s", "z", None)], 1)
    load([("s", "a", None), ("s", "m", None), ("s", "z", "south"), ("s", "z", "south")], 2)
    got = {r["district"]: (r["district_id"], r["region"], r["created_at"].day) for r in lake.read_version(spark, path).collect()}
    assert got == {"m": (1, "north", 1), "z": (2, "south", 1), "a": (3, None, 2)}
