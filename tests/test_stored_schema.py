"""Stored schemas: added and widened columns without footers, and alerts of a run."""

import pytest

from fieldmart import schemas
from fieldmart.plans import medallion, silver
from fieldmart.sources import lake, stored_schema
from samples import RETAILER_SCHEMA, RETAILERS
from test_medallion import names, write_csv

ONE = "k string, v int, day string"


def put(spark, path, rows, schema, **options):
    lake.write_partitioned(spark.createDataFrame(rows, schema), path, ["day"], **options)


def test_new_and_wider_columns_are_read_for_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", 1, "d1")], ONE)
    put(spark, path, [("b", 5_000_000_000, "x", "d2")], "k string, v bigint, note string, day string")
    put(spark, path, [("c", 3, "d3")], ONE)  # a narrower delivery changes nothing
    got = sorted(tuple(r) for r in lake.read_optional(spark, path).select("k", "v", "note", "day").collect())
    assert got == [("a", 1, None, "d1"), ("b", 5_000_000_000, "x", "d2"), ("c", 3, None, "d3")]
    assert stored_schema.current(spark, path).simpleString() == "struct<k:string,v:bigint,day:string,note:string>"
    with pytest.raises(stored_schema.SchemaConflict, match="v is bigint in the table and arrives as string"):
        put(spark, path, [("d", "x", "d4")], "k string, v string, day string")
    assert lake.read_optional(spark, path).count() == 3


def test_a_rebuild_starts_a_new_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", 1, "d1")], ONE)
    put(spark, path, [("a", "x", "d1")], "k string, v string, day string", replace="all")
    assert stored_schema.current(spark, path)["v"].dataType.simpleString() == "string"
    assert [tuple(r) for r in lake.read_optional(spark, path).select("k", "v").collect()] == [("a", "x")]


def test_reading_opens_no_file(spark, tmp_path):
    path = tmp_path / "t"
    put(spark, str(path), [("a", 1, "d1"), ("b", 1, "d2")], ONE)
    for part in path.glob("day=d1/*.parquet"):
        part.write_bytes(b"not parquet")
    frame = lake.read_optional(spark, str(path))
    assert frame.columns == ["k", "v", "day"] and frame.filter("day = 'd2'").count() == 1


def test_two_writers_add_a_column_each(spark, tmp_path, monkeypatch):
    path, real, tried = str(tmp_path / "t"), stored_schema.files.create, []
    base = schemas.schema_of("k string")
    stored_schema.evolve(spark, path, base)

    def late(session, where, text):
        if not tried:
            tried.append(1)
            monkeypatch.setattr(stored_schema.files, "create", real)
            stored_schema.evolve(spark, path, schemas.schema_of("k string, b int"))
        return real(session, where, text)

    monkeypatch.setattr(stored_schema.files, "create", late)
    assert stored_schema.evolve(spark, path, schemas.schema_of("k string, a int")).fieldNames() == ["k", "b", "a"]


def test_merge_into_silver_takes_in_a_new_column(spark, tmp_path):
    path, kinds = str(tmp_path / "s"), "k string, ingestion_timestamp string, ingestion_date string"
    silver.merge_newest(spark, spark.createDataFrame([("a", "1", "2024-01-01"), ("b", "1", "2024-01-01")], kinds), path, ["k"])
    silver.merge_newest(spark, spark.createDataFrame([("b", "2", "2024-01-02", "new")], kinds + ", note string"), path, ["k"])
    assert sorted((r["k"], r["note"]) for r in lake.read_optional(spark, path).collect()) == [("a", None), ("b", "new")]


def test_a_run_writes_its_alerts(spark, tmp_path):
    raw, target = tmp_path / "raw", str(tmp_path / "lake")
    write_csv(raw, "features_retailers", names(RETAILER_SCHEMA), RETAILERS)
    medallion.run(spark, str(raw), target, run_id="r1", environment="prod")
    medallion.write_alerts(spark, target, "r1", "prod")  # again: nothing more
    (alert,) = medallion.alerts(spark, target).collect()
    assert (alert["table_name"], alert["subject"]) == ("retailer", "[PROD] DQ Failure: retailer")
    # The sample has fewer rows than the least number of 10, and one rule more fails.
    failed = {r["rule"] for r in spark.read.json(f"{target}/dq_reports").selectExpr("inline(rules)").filter("NOT passed").collect()}
    lines = alert["message"].split("\n")
    assert alert["failed_rules"] == len(failed) == len(lines) and {line.split(" | ")[0] for line in lines} == failed
    assert any("10" in rule for rule in failed)
