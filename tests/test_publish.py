"""Rebuilds that readers never notice, and writers that never share a version."""

import threading

import pytest
from pyspark.sql import functions as F

from fieldmart.plans import mart, silver
from fieldmart.sources import files, lake


def rows(spark, n, day="2031-01-01"):
    return spark.range(n).withColumns({"day": F.lit(day), "v": F.lit(n)})


def test_a_reader_planned_before_a_rebuild_ends_with_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_partitioned(rows(spark, 3), path, ["day"], "publish")
    reader = lake.read_optional(spark, path)
    assert lake.write_partitioned(rows(spark, 5, "2031-01-02"), path, ["day"], "publish", [lake.row_count()]) == {"rows": 5}
    assert reader.count() == 3 and lake.read_optional(spark, path).count() == 5
    lake.write_partitioned(rows(spark, 1), path, ["day"], "publish")
    assert list(lake.versions(spark, path)) == [3, 2] and not files.exists(spark, f"{path}/v0000000001")
    # Touched partitions are replaced in the newest version.
    lake.write_partitioned(rows(spark, 2, "2031-01-09"), path, ["day"])
    assert lake.read_optional(spark, path).count() == 3 and lake.location(spark, path).endswith("v0000000003")


def test_a_failed_rebuild_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_partitioned(rows(spark, 3), path, ["day"], "publish")
    broken = rows(spark, 4).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        lake.write_partitioned(broken, path, ["day"], "publish")
    assert lake.read_optional(spark, path).count() == 3
    lake.write_partitioned(rows(spark, 6), path, ["day"], "publish")
    assert lake.read_optional(spark, path).count() == 6 and list(lake.versions(spark, path)) == [3, 1]


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    path, got = str(tmp_path / "t"), []
    threads = [threading.Thread(target=lambda n=n: got.append((lake.write_version(spark.range(n), path), n))) for n in range(1, 6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(v for v, _ in got) == [1, 2, 3, 4, 5] and len(list(lake.versions(spark, path))) == 5
    assert all(lake.read_version(spark, path, version).count() == n for version, n in got)


def test_a_write_from_an_overtaken_version_is_refused(spark, tmp_path, monkeypatch):
    fact, path = "retailer_id string, week string, v int", str(tmp_path / "t")
    mart.apply_upsert(spark, spark.createDataFrame([("a", "w", 1)], fact), path)
    real, once = lake._claim_version, []

    def overtaken(session, where):
        if not once:
            once.append(1)
            mart.apply_upsert(session, session.createDataFrame([("b", "w", 2)], fact), where)
        return real(session, where)

    monkeypatch.setattr(lake, "_claim_version", overtaken)
    late = spark.createDataFrame([("c", "w", 3)], fact)
    with pytest.raises(lake.VersionConflict):
        mart.apply_upsert(spark, late, path)
    mart.apply_upsert(spark, late, path)
    assert sorted(r["retailer_id"] for r in lake.read_version(spark, path).collect()) == ["a", "b", "c"]


def test_a_day_is_merged_into_a_published_table(spark, tmp_path):
    path = str(tmp_path / "silver")
    fact = "k int, v int, ingestion_date string, ingestion_timestamp int"
    first = spark.createDataFrame([(1, 1, "2031-01-01", 1), (2, 1, "2031-01-01", 1)], fact)
    lake.write_partitioned(first, path, ["ingestion_date"], "publish")
    silver.merge_newest(spark, spark.createDataFrame([(1, 2, "2031-01-02", 2), (2, 2, "2031-01-02", 2)], fact), path, ["k"])
    got = lake.read_optional(spark, path)
    assert sorted((r["k"], r["v"], str(r["ingestion_date"])) for r in got.collect()) == [(1, 2, "2031-01-02"), (2, 2, "2031-01-02")]
    assert files.subfolders(spark, lake.location(spark, path)) == ["_schema", "ingestion_date=2031-01-02"]
