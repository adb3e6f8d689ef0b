import json

from pyspark.sql import functions as F

from fieldmart.operators import dq


def result(frame, rule):
    return dq.evaluate(frame, [rule]).first().asDict()


def test_not_null_counts_rows_once_and_skips_absent_columns(spark):
    frame = spark.createDataFrame([(None, None), ("a", None), ("a", "b")], "x string, y string")
    row = result(frame, dq.not_null(frame, ["x", "y", "absent"]))
    assert row["rule"] == "NOT_NULL(x, y, absent)"
    assert (row["passed"], row["fail_count"], row["total"], row["fail_pct"]) == (False, 2, 3, 66.67)


def test_not_null_strict_raises_on_an_absent_column(spark):
    frame = spark.createDataFrame([("a",)], "x string")
    try:
        dq.evaluate(frame, [dq.not_null(frame, ["absent"], strict=True)]).collect()
    except Exception as error:
        assert "absent" in str(error)
    else:
        raise AssertionError("expected an error")


def test_nan_counts_only_on_request(spark):
    frame = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert result(frame, dq.not_null(frame, ["x"]))["fail_count"] == 0
    assert result(frame, dq.not_null(frame, ["x"], nan_as_null=True))["fail_count"] == 1


def test_non_negative_lets_null_pass(spark):
    frame = spark.createDataFrame([(-1.0, 1), (None, -2), (None, None), (0.0, 0)], "x double, y int")
    assert result(frame, dq.non_negative(frame, ["x", "y"]))["fail_count"] == 2


def test_unique_treats_null_as_a_value(spark):
    frame = spark.createDataFrame([("a", None), ("a", None), (None, None), (None, None), ("a", "b")], "x string, y string")
    row = result(frame, dq.unique(frame, ["x", "y", "absent"]))
    assert (row["rule"], row["fail_count"], row["total"]) == ("UNIQUE(x, y)", 2, 5)


def test_unique_with_a_hot_key(spark):
    frame = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert result(frame, dq.unique(frame, ["k"]))["fail_count"] == 9_999


def test_row_count_fails_once(spark):
    frame = spark.range(3)
    assert result(frame, dq.min_rows(3))["passed"]
    row = result(frame, dq.min_rows(4))
    assert (row["fail_count"], row["details"]) == (1, "Expected >= 4 rows, got 3")


def test_empty_frame_has_zero_percent(spark):
    frame = spark.createDataFrame([], "x string")
    rows = dq.evaluate(frame, [dq.not_null(frame, ["x"]), dq.unique(frame, ["x"]), dq.min_rows(1)]).collect()
    assert [(r["passed"], r["fail_count"], r["total"], r["fail_pct"]) for r in rows] == [
        (True, 0, 0, 0.0), (True, 0, 0, 0.0), (False, 1, 0, 0.0)
    ]


def test_percentages_round_exact_halves_to_even(spark):
    frame = spark.range(800).select(F.when(F.col("id") >= 97, F.col("id")).alias("x"))
    assert result(frame, dq.not_null(frame, ["x"]))["fail_pct"] == 12.12


def test_freshness(spark):
    frame = spark.sql(
        "select cast(t as timestamp) t from values ('2024-01-01 00:00:00'), ('2024-01-03 00:00:00'), (null) as v(t)"
    )
    row = result(frame, dq.freshness("t", 48, F.lit("2024-01-03 00:00:01").cast("timestamp")))
    assert (row["fail_count"], row["total"]) == (1, 3)
    assert result(frame, dq.freshness("t", 48, F.lit("2024-01-03 00:00:00").cast("timestamp")))["passed"]
    assert result(frame, dq.freshness("t"))["fail_count"] == 2


def test_referential(spark):
    facts = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [(None,)], "district string")
    master = spark.createDataFrame([("a",), ("a",), ("c",)], "district string")
    row = dq.referential(facts, ["district"], master).first()
    assert (row["fail_count"], row["total"], row["passed"]) == (4, 54, False)
    assert dq.referential(facts.filter("district = 'a'"), ["district"], master).first()["passed"]
    assert dq.referential(facts.limit(0), ["district"], master).first()["total"] == 0


def test_a_suite_is_one_pass(spark):
    frame = spark.createDataFrame([("a", -1.0)], "x string, v double")
    rules = [dq.not_null(frame, ["x"]), dq.non_negative(frame, ["v"]), dq.unique(frame, ["x"]), dq.min_rows(1)]
    plan = dq.evaluate(frame, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_report_and_alerts(spark):
    frame = spark.createDataFrame([(None, -1.0)], "x string, v double")
    run_time = F.lit("2024-01-31 02:00:00").cast("timestamp")
    bad = dq.report(dq.checked(frame, [dq.not_null(frame, ["x"]), dq.min_rows(1)]), "t", run_time)
    document = json.loads(bad.toJSON().first())
    assert document["table"] == "t" and document["run_time"] == "2024-01-31T02:00:00Z"
    assert document["overall_passed"] is False and [r["passed"] for r in document["rules"]] == [False, True]
    alert = dq.alerts(bad, "dev", "reports/t", "run-1").first()
    assert alert["subject"] == "[DEV] DQ Failure: t" and alert["failed_rules"] == 1
    assert alert["message"].startswith("NOT_NULL(x) | fail_count=1 | fail_pct=100.0%")
    assert [r["rule"] for r in dq.failed_rules(bad).collect()] == ["NOT_NULL(x)"]
    good = dq.report(dq.checked(frame, [dq.min_rows(1)]), "t", run_time)
    assert good.first()["overall_passed"] and dq.alerts(good).count() == 0


def test_rules_by_key_equal_rules_one_by_one(spark):
    rows = [("a", None, -1.0), ("a", None, 2.0), (None, None, None), (None, None, -3.0), ("b", 1, 0.0), ("b", 1, 0.0), ("b", 2, 5.0)]
    for frame in (spark.createDataFrame(rows, "x string, y int, v double"), spark.createDataFrame([], "x string, y int, v double")):
        rules = [dq.not_null(frame, ["x", "y"]), dq.non_negative(frame, ["v"]), dq.unique(frame, ["x", "y"]), dq.min_rows(8)]
        together = dq.evaluate(frame, rules).collect()
        alone = [dq.evaluate(frame, [dq.Rule(r.name, r.failures, r.details)]).first() for r in rules]
        assert together == alone
    two_keys = [dq.unique(frame, ["x"]), dq.unique(frame, ["y"])]
    assert [r["fail_count"] for r in dq.evaluate(spark.createDataFrame(rows, "x string, y int, v double"), two_keys).collect()] == [4, 4]


def test_uniqueness_needs_no_exchange_behind_a_join_by_a_column_of_the_key(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "x string, y int").repartition("x")
    plan = dq.evaluate(frame, [dq.not_null(frame, ["x"]), dq.unique(frame, ["x", "y"])])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
