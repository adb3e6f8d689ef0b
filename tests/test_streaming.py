import os
import time

from pyspark.sql import functions as F

from fieldmart import schemas
from fieldmart.operators import metrics
from fieldmart.sources import lake
from fieldmart.streaming import jobs, late
from samples import RETAILER_SCHEMA, RETAILERS
from test_medallion import names, write_csv

EVENT = "event_id bigint, ts timestamp, value double, copy int"


def events(spark, rows):
    frame = spark.createDataFrame(rows, "event_id bigint, ts string, value double, copy int")
    return frame.withColumn("ts", F.col("ts").cast("timestamp"))


def test_each_file_is_ingested_once(spark, tmp_path):
    landing, target, offsets = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "offsets")
    landing.mkdir()

    def run():
        jobs.ingest_csv(spark, str(landing), schemas.RAW_RETAILERS, target, offsets).awaitTermination()
        return spark.read.parquet(target).count()

    write_csv(landing / "day1", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[:4])
    assert run() == 4
    assert run() == 4
    write_csv(landing / "day2", "features_retailers", names(RETAILER_SCHEMA), RETAILERS[4:])
    (landing / "ignored.txt").write_text("x")
    assert run() == 6
    assert any(name.startswith("ingestion_date=") for name in os.listdir(target))


def test_redelivered_rows_are_dropped_across_files_and_batches(spark, tmp_path):
    landing, target, offsets = str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "offsets")
    hot = [(1, "2024-01-01 00:00:00", 1.0, c) for c in range(300)]
    rest = [(i, "2024-01-01 00:00:01", 1.0, 0) for i in range(2, 202)]
    for delivery in range(2):
        events(spark, hot + rest).repartition(4).write.mode("append").parquet(landing)
        rows = jobs.read_files(spark, landing, events(spark, rest).schema).withColumn("file", F.col("_metadata.file_path"))
        kept = jobs.drop_redelivered(rows, ["event_id"], source="file")
        jobs.append_parquet(kept.select("event_id"), target, offsets).awaitTermination()
        assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == list(range(1, 202))


def test_closed_windows_equal_the_batch_result(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", i / 4, i % 2) for i in range(500)]
    landing = str(tmp_path / "landing")
    events(spark, rows).write.parquet(landing)
    batch = metrics.rollup(spark.read.parquet(landing), "1 hour", ["copy"])
    stream = jobs.rollup(jobs.read_files(spark, landing, events(spark, rows).schema), "1 hour", ["copy"])
    jobs.append_parquet(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in batch.collect() if r["window_start"].hour < 23}
    assert got == want and len(got) > 20


def test_alarm_threshold(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", 0.0, 0), (2, "2024-01-01 00:06:00", 1.0, 0), (3, "2024-01-01 00:07:00", 2.0, 0),
            (4, "2024-01-01 05:00:00", 9.0, 0)]
    landing = str(tmp_path / "landing")
    events(spark, rows).write.parquet(landing)
    stream = jobs.alarms(jobs.read_files(spark, landing, events(spark, rows).schema), F.col("value").cast("int"))
    jobs.append_parquet(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    assert [(str(r["window_start"]), r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [
        ("2024-01-01 00:05:00", 3)
    ]


def test_stream_upsert_keeps_the_newest_row_per_key(spark, tmp_path):
    fact = "retailer_id string, week string, v int, at int"
    landing, path, offsets = str(tmp_path / "landing"), str(tmp_path / "fact"), str(tmp_path / "offsets")
    lake.write_version(spark.createDataFrame([("a", "w1", 1, 1), ("b", "w1", 1, 1)], fact), path)
    for batch in ([("b", "w1", 2, 2), ("b", "w1", 3, 3)], [("c", "w1", 4, 4)]):
        staged = spark.createDataFrame(batch, fact)
        staged.write.mode("append").parquet(landing)
        rows = jobs.read_files(spark, landing, staged.schema)
        jobs.upsert_into(rows, path, ["retailer_id", "week"], "at", offsets).awaitTermination()
    got = {(r["retailer_id"], r["v"]) for r in lake.read_version(spark, path).collect()}
    assert got == {("a", 1), ("b", 3), ("c", 4)}


def test_buffer_interval_keeps_the_query_running(spark, tmp_path):
    landing = str(tmp_path / "landing")
    events(spark, [(1, "2024-01-01 00:00:00", 1.0, 0)]).write.parquet(landing)
    rows = jobs.read_files(spark, landing, spark.read.parquet(landing).schema)
    running = jobs.append_parquet(rows, str(tmp_path / "out"), str(tmp_path / "offsets"), buffer_seconds=1)
    try:
        running.processAllAvailable()
        assert running.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 1
    finally:
        running.stop()


def test_late_rows_are_counted_once_per_batch(spark, tmp_path):
    landing, target, offsets, counts = (str(tmp_path / n) for n in ("landing", "out", "offsets", "late"))
    assert late.late_rows(spark, counts).count() == 0
    listener = late.LateRowListener(spark, counts)
    spark.streams.addListener(listener)
    try:
        deliveries = [
            [(1, "2024-01-01 12:00:00", 1.0, 0), (2, "2024-01-01 12:05:00", 1.0, 0)],
            [(i, "2024-01-01 10:00:00", 1.0, 0) for i in range(3, 10)] + [(20, "2024-01-01 12:01:00", None, 0), (21, None, 1.0, 0)],
            [(30, "2024-01-01 09:00:00", 1.0, 0), (31, "2024-01-01 13:00:00", 1.0, 0)],
        ]
        for delivery in deliveries:
            events(spark, delivery).write.mode("append").parquet(landing)
            rows = jobs.read_files(spark, landing, events(spark, delivery).schema)
            query = jobs.append_parquet(jobs.drop_redelivered(rows, ["event_id"]), target, offsets)
            query.awaitTermination()
            late.keep_recent(query, spark, counts)
            late.keep_recent(query, spark, counts)
        time.sleep(2)  # the listener reports the same batches
    finally:
        spark.streams.removeListener(listener)
    found = late.late_rows(spark, counts)
    assert sorted(r["n_late"] for r in found.collect()) == [1, 7] and {r["operator"] for r in found.collect()} == {0}
    kept = spark.read.parquet(target).count()
    assert kept == 5 and kept + sum(r["n_late"] for r in found.collect()) == sum(map(len, deliveries))
