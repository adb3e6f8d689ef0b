import datetime
import os

import pytest
from pyspark.sql import functions as F

from fieldmart import schemas
from fieldmart.operators import upsert
from fieldmart.operators.shaping import MissingColumns, first_existing, narrow, project, typed, with_default
from fieldmart.plans import mart
from fieldmart.sources import catalog, lake, staging


def days(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, ingestion_date string")


def test_touched_partitions_are_replaced_and_other_days_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_partitioned(days(spark, [("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")]), path, ["ingestion_date"])
    lake.write_partitioned(days(spark, [("c", 2, "2024-01-02")]), path, ["ingestion_date"])
    got = {(r["k"], r["ingestion_date"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", datetime.date(2024, 1, 1)), ("c", datetime.date(2024, 1, 2))}


def test_a_rebuild_replaces_all_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_partitioned(days(spark, [("a", 1, "2024-01-01")]), path, ["ingestion_date"])
    lake.write_partitioned(days(spark, [("a", 2, "2024-01-02")]), path, ["ingestion_date"], replace="all")
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2]


def test_optional_input(spark, tmp_path):
    assert lake.read_optional(spark, str(tmp_path / "missing")) is None
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        lake.read_optional(spark, str(broken)).count()


def test_latest_partition(spark):
    frame = days(spark, [("a", 1, "2024-01-01"), ("b", 1, "2024-01-03"), ("c", 1, "2024-01-03")])
    assert {r["k"] for r in lake.latest_partition(frame).collect()} == {"b", "c"}


def test_versions_count_once_committed(spark, tmp_path):
    path = str(tmp_path / "t")
    assert lake.read_version(spark, path) is None
    assert lake.write_version(spark.range(3), path) == 1
    # A table may be derived from the version it replaces.
    assert lake.write_version(lake.read_version(spark, path).filter("id > 0"), path) == 2
    os.makedirs(f"{path}/v0000000003")  # a writer that died before its commit
    assert list(lake.versions(spark, path)) == [2, 1]
    assert lake.read_version(spark, path).count() == 2
    assert lake.read_version(spark, path, 1).count() == 3
    assert lake.write_version(spark.range(1), path) == 4
    assert lake.drop_old_versions(spark, path, keep=2) == [1]
    assert list(lake.versions(spark, path)) == [4, 2] and lake.read_version(spark, path).count() == 1


FACT = "retailer_id string, week string, v int"


def test_upsert_replaces_inserts_and_is_idempotent(spark, tmp_path):
    target = spark.createDataFrame([("a", "w1", 1), ("b", "w1", 1), (None, "w1", 1)], FACT)
    staged = spark.createDataFrame([("b", "w1", 2), ("c", "w1", 2), ("c", "w1", 3), (None, "w1", 2)], FACT)
    once = upsert.upsert(target, staged, schemas.UPSERT_KEYS)
    rows = sorted(map(str, once.collect()))
    # Every staged row is kept, and NULL keys never match.
    assert len(rows) == 6 and {r["v"] for r in once.filter("retailer_id = 'b'").collect()} == {2}
    distinct = staged.filter("retailer_id is not null")
    first = upsert.upsert(target, distinct, schemas.UPSERT_KEYS)
    again = upsert.upsert(first, distinct, schemas.UPSERT_KEYS)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_upsert_matches_columns_by_name(spark):
    target = spark.createDataFrame([("a", "w1", 1, "x")], FACT + ", loaded_at string")
    staged = spark.createDataFrame([(2, "w1", "b", 0)], "v int, week string, retailer_id string, extra int")
    got = {tuple(r) for r in upsert.upsert(target, staged, schemas.UPSERT_KEYS).collect()}
    # A column only the increment has is kept, and NULL for stored rows.
    assert got == {("a", "w1", 1, "x", None), ("b", "w1", 2, None, 0)}
    assert upsert.append_by_name(target, staged).count() == 2


def test_versioned_upsert(spark, tmp_path):
    path = str(tmp_path / "fact")
    mart.apply_upsert(spark, spark.createDataFrame([("a", "w1", 1), ("b", "w1", 1)], FACT), path)
    mart.apply_upsert(spark, spark.createDataFrame([("b", "w1", 2), ("c", "w2", 2)], FACT), path)
    got = {tuple(r) for r in lake.read_version(spark, path).collect()}
    assert got == {("a", "w1", 1), ("b", "w1", 2), ("c", "w2", 2)}


def test_partition_upsert_opens_only_staged_partitions(spark, tmp_path):
    path = str(tmp_path / "fact")
    mart.upsert_partitions(spark, spark.createDataFrame([("a", "w1", 1), ("b", "w1", 1), ("a", "w2", 1)], FACT), path)
    untouched = {f: os.path.getmtime(f"{path}/week=w2/{f}") for f in os.listdir(f"{path}/week=w2")}
    for _ in range(2):
        mart.upsert_partitions(spark, spark.createDataFrame([("b", "w1", 2), ("c", "w3", 2)], FACT), path)
        got = {(r["retailer_id"], r["week"], r["v"]) for r in spark.read.parquet(path).collect()}
        assert got == {("a", "w1", 1), ("b", "w1", 2), ("a", "w2", 1), ("c", "w3", 2)}
    assert untouched == {f: os.path.getmtime(f"{path}/week=w2/{f}") for f in os.listdir(f"{path}/week=w2")}
    with pytest.raises(ValueError):
        mart.upsert_partitions(spark, spark.createDataFrame([("b", "w1", 2)], FACT), path, partition_by="v")


def test_partition_upsert_keeps_columns_the_increment_lacks(spark, tmp_path):
    path = str(tmp_path / "fact")
    first = spark.createDataFrame([("a", "01", 1, "x"), ("b", "01", 1, "y")], FACT + ", note string")
    mart.upsert_partitions(spark, first, path)
    mart.upsert_partitions(spark, spark.createDataFrame([("b", "01", 2)], FACT), path)
    stored = spark.read.schema(FACT + ", note string").parquet(path)
    got = {(r["retailer_id"], r["week"], r["v"], r["note"]) for r in stored.collect()}
    assert got == {("a", "01", 1, "x"), ("b", "01", 2, None)}


def test_partition_upsert_keeps_rows_without_a_key(spark, tmp_path):
    path = str(tmp_path / "fact")
    mart.upsert_partitions(spark, spark.createDataFrame([("a", None, 1), ("b", "w1", 1)], FACT), path)
    mart.upsert_partitions(spark, spark.createDataFrame([("a", None, 2)], FACT), path)
    got = sorted((r["retailer_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_external_table_sees_rows_once_partitions_are_loaded(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = days(spark, [("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")])
    lake.write_partitioned(frame, path, ["ingestion_date"])
    catalog.create_database(spark, "cat_test", str(tmp_path / "db"))
    spark.sql(
        f"CREATE TABLE cat_test.bare (k string, v int, ingestion_date string) USING parquet "
        f"PARTITIONED BY (ingestion_date) LOCATION '{path}'"
    )
    assert spark.table("cat_test.bare").count() == 0
    table = catalog.register_external(spark, "cat_test.t", frame.schema, ["ingestion_date"], path)
    assert table.count() == 2
    plan = table.filter("ingestion_date = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingestion_date" in plan
    assert catalog.newest_partition(spark, "cat_test.t", "ingestion_date") == "2024-01-02"
    wider = frame.withColumn("extra", F.lit(1)).schema
    assert catalog.add_new_columns(spark, "cat_test.t", wider) == ["extra"]
    assert catalog.add_new_columns(spark, "cat_test.t", wider) == []
    assert "extra" in spark.table("cat_test.t").columns


def test_bucketed_layout_groups_without_an_exchange(spark, tmp_path):
    catalog.create_database(spark, "bucket_test", str(tmp_path / "db"))
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("district"),
        F.col("id").alias("retailer_id"), (F.col("id") % 5).alias("ingestion_date"),
    )
    table = catalog.save_bucketed(
        frame, "bucket_test.fact", str(tmp_path / "fact"), "district", ["ingestion_date", "district"], 4, ["retailer_id"]
    )
    grouped = table.groupBy("district").count()
    assert grouped.filter("district = 'hot'").first()["count"] == 1000
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_staging_prefers_the_configured_folder(spark, tmp_path):
    configured = spark.conf.get(staging.CHECKPOINT_DIR, None)
    root = staging.shared_root(spark)
    assert root == configured.rstrip("/") if configured else root.startswith("file:/tmp/")
    assert staging.fresh_path(spark, "x") != staging.fresh_path(spark, "x")


def test_a_staged_block_cleans_up_only_on_success(spark, monkeypatch, tmp_path):
    paths = iter([str(tmp_path / "good"), str(tmp_path / "bad")])
    monkeypatch.setattr(staging, "fresh_path", lambda *_: next(paths))
    with staging.staged(spark.range(3), "x") as frame:
        assert frame.count() == 3
    with pytest.raises(RuntimeError):
        with staging.staged(spark.range(3), "x"):
            raise RuntimeError
    assert not (tmp_path / "good").exists() and (tmp_path / "bad").exists()


def test_projection_and_aliases(spark):
    frame = spark.createDataFrame([("3.7", "x", "12", "1e3")], "a string, b string, c string, d string")
    assert project(frame, ["c", "absent", "a"]).columns == ["c", "a"]
    with pytest.raises(MissingColumns):
        project(frame, ["absent"], strict=True)
    with pytest.raises(MissingColumns):
        first_existing(frame, "p", "q")
    row = typed(frame, {"a": "int", "b": "double", "z": "double", "d": "double"}, {"z": ["y", "c"]}).first()
    assert (row["a"], row["b"], row["z"], row["d"]) == (3, None, 12.0, 1000.0)
    assert with_default(frame, "a", F.lit(0)).first()["a"] == "3.7"
    assert with_default(frame, "n", F.lit(0)).first()["n"] == 0


def test_narrow_to_mart_types(spark):
    frame = spark.createDataFrame([(123456789.126, None, "7"), (1e20, 1, "x")], "d double, f int, s string")
    spec = [("d", "decimal(12,2)", None), ("f", "smallint", 0), ("s", "int", None), ("absent", "smallint", 0)]
    first, second = narrow(frame, spec).collect()
    assert (str(first["d"]), first["f"], first["s"], first["absent"]) == ("123456789.13", 0, 7, 0)
    assert second["d"] is None and second["s"] is None


def test_rejects_and_accepted_split_the_rows(spark):
    rows = [("a", "st", "d", "2024-W01"), (None, "st", "d", "2024-W01"), ("b", "st", None, "2024-W01-late")]
    frame = spark.createDataFrame(rows, "retailer_id string, state string, district string, week string")
    bad = {r["retailer_id"]: r["reasons"] for r in mart.rejects(frame, "retailer_kpi").collect()}
    assert bad == {None: ["retailer_id is null"], "b": ["district is null", "week is longer than 10"]}
    assert [r["retailer_id"] for r in mart.accepted(frame, "retailer_kpi").collect()] == ["a"]


def test_district_dimension(spark):
    rows = [("d2", "s1"), ("d1", "s1"), ("d1", "s1"), ("d0", "s2")]
    got = mart.district_dimension(spark.createDataFrame(rows, "district string, state string")).orderBy("district_id")
    assert [(r["district_id"], r["district"], r["region"]) for r in got.collect()] == [
        (1, "d1", None), (2, "d2", None), (3, "d0", None)
    ]
