"""Data-quality rules compiled into one aggregate per table.

A rule is an aggregate expression giving its number of failures.  All rules of a
table run in one pass: partial aggregates are combined in the map tasks, and a
uniqueness rule adds one key-wise exchange whose rows are already collapsed per
task, so a hot key costs nothing extra.  Where the input is dealt out by columns of the
key already, as after a join, there is no exchange.  Rules report; they never drop rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule names and detail texts of the report.
NOT_NULL_DETAILS = "Null found in critical columns: {columns}"
NON_NEGATIVE_DETAILS = "Negative values found in: {columns}"
UNIQUE_DETAILS = "Duplicate rows on key: {columns}"
MIN_ROWS_DETAILS = "Expected >= {min_rows} rows, got {total}"
FRESHNESS_DETAILS = "Stale data detected: {fails} rows ingested older than {hours} hours"
REFERENTIAL_DETAILS = "Values missing in the master: {columns}"

RESULT_COLUMNS = ("rule", "passed", "fail_count", "total", "fail_pct", "details")


@dataclass(frozen=True)
class Rule:
    """A named check: failures as an aggregate, details from (fail count, total).

    Failures that are a number of rows also name the ``test`` those rows meet, and rows
    beyond the first per key name its columns, ``keys``; a least number of rows is named as
    such.  Such rules need no distinct aggregate: rows are grouped by key and the groups
    are added up.
    """

    name: str
    failures: Column
    details: Callable[[Column, Column], Column]
    test: Column | None = None
    keys: tuple[str, ...] = ()
    least: int | None = None


def _listed(columns: Sequence[str]) -> str:
    return ", ".join(columns)


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _fixed(text: str) -> Callable[[Column, Column], Column]:
    return lambda fails, total: F.lit(text)


def not_null(df: DataFrame, columns: Sequence[str], nan_as_null: bool = False, strict: bool = False) -> Rule:
    """Rows with a NULL in any column; absent columns are skipped unless ``strict``."""
    present = list(columns) if strict else _present(df, columns)
    types = dict(df.dtypes)
    tests = [F.col(c).isNull() for c in present]
    if nan_as_null:
        tests += [F.isnan(c) for c in present if types.get(c) in ("double", "float")]
    return Rule(
        f"NOT_NULL({_listed(columns)})",
        F.count_if(_any(tests)),
        _fixed(NOT_NULL_DETAILS.format(columns=list(columns))),
        _any(tests),
    )


def non_negative(df: DataFrame, columns: Sequence[str]) -> Rule:
    """Rows with a value below zero in any column; NULL passes."""
    negative = _any([F.col(c) < 0 for c in _present(df, columns)])
    return Rule(
        f"NON_NEGATIVE({_listed(columns)})",
        F.count_if(negative),
        _fixed(NON_NEGATIVE_DETAILS.format(columns=list(columns))),
        negative,
    )


def unique(df: DataFrame, keys: Sequence[str]) -> Rule:
    """Rows beyond the first per key; NULL is a key value like any other."""
    present = _present(df, keys)
    total = F.count(F.lit(1))
    distinct = F.count_distinct(F.struct(*present)) if present else total
    return Rule(
        f"UNIQUE({_listed(present)})",
        total - distinct,
        _fixed(UNIQUE_DETAILS.format(columns=present)),
        keys=tuple(present),
    )


def min_rows(count: int = 1) -> Rule:
    """One failure when the table has fewer than ``count`` rows."""
    return Rule(
        f"MIN_ROWS({count})",
        F.when(F.count(F.lit(1)) >= count, 0).otherwise(1).cast("bigint"),
        lambda fails, total: F.format_string(
            MIN_ROWS_DETAILS.format(min_rows=count, total="%d"), total
        ),
        least=count,
    )


def freshness(column: str, max_hours: int = 48, as_of: Column | None = None) -> Rule:
    """Rows older than ``max_hours`` before ``as_of`` (now by default); NULL passes."""
    moment = F.current_timestamp() if as_of is None else as_of
    oldest = moment - F.make_interval(hours=F.lit(max_hours))
    return Rule(
        f"FRESHNESS({column}, {max_hours}h)",
        F.count_if(F.col(column) < oldest),
        lambda fails, total: F.format_string(
            FRESHNESS_DETAILS.format(fails="%d", hours=max_hours), fails
        ),
        F.col(column) < oldest,
    )


def _result(rule: Rule, fails: Column, total: Column) -> Column:
    """The report entry; the percentage rounds exact halves to even."""
    percent = F.when(total > 0, F.bround(fails / total * 100, 2)).otherwise(0.0)
    return F.struct(
        F.lit(rule.name).alias("rule"),
        (fails == 0).alias("passed"),
        fails.alias("fail_count"),
        total.alias("total"),
        percent.alias("fail_pct"),
        rule.details(fails, total).alias("details"),
    )


def _counted_by_key(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Total and failures of all rules, one row, from one grouping by the key of the uniqueness rule."""
    tests = {f"_fails_{i}": rule.test for i, rule in enumerate(rules) if rule.test is not None}
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(test).alias(name) for name, test in tests.items()]
    )
    summed = per_key.agg(
        F.count(F.lit(1)).alias("_distinct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_total", *tests)]
    )
    total, counts = F.col("_total"), []
    for i, rule in enumerate(rules):
        name = f"_fails_{i}"
        if rule.keys:
            counts.append((total - F.col("_distinct")).alias(name))
        elif rule.least is not None:
            counts.append(F.when(total >= rule.least, 0).otherwise(1).cast("bigint").alias(name))
        else:
            counts.append(F.col(name))
    return summed.select("_total", *counts)


def checked(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row holding ``rules``, the array of all rule results, from one pass."""
    keys = {rule.keys for rule in rules if rule.keys}
    if len(keys) == 1 and all(rule.test is not None or rule.keys or rule.least is not None for rule in rules):
        counts = _counted_by_key(df, rules, keys.pop())
    else:
        counts = df.agg(
            F.count(F.lit(1)).alias("_total"),
            *[rule.failures.alias(f"_fails_{i}") for i, rule in enumerate(rules)],
        )
    entries = [_result(rule, F.col(f"_fails_{i}"), F.col("_total")) for i, rule in enumerate(rules)]
    return counts.select(F.array(*entries).alias("rules"))


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rule, passed, fail_count, total, fail_pct, details."""
    return checked(df, rules).select(F.inline("rules"))


def referential(df: DataFrame, columns: Sequence[str], master: DataFrame) -> DataFrame:
    """Rows whose key is not in ``master``, as one rule result; a NULL key fails.

    The fact side is counted per key before the anti join, so the join sees each
    value once however many rows carry it.
    """
    columns = list(columns)
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    known = master.select(*columns).distinct().withColumn("_known", F.lit(True))
    rule = Rule(
        f"REFERENTIAL({_listed(columns)})",
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_rows"))), F.lit(0)),
        _fixed(REFERENTIAL_DETAILS.format(columns=columns)),
    )
    counts = per_key.join(known, columns, "left").agg(
        rule.failures.alias("_fails"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total")
    )
    entry = _result(rule, F.col("_fails"), F.col("_total"))
    return counts.select(F.inline(F.array(entry)))


def with_results(checks: DataFrame, results: DataFrame) -> DataFrame:
    """``checked`` output with further rule results, such as ``referential`` ones, added.

    Both sides are a handful of rows that summarise a table.
    """
    extra = results.agg(F.collect_list(F.struct(*RESULT_COLUMNS)).alias("extra")).scalar()
    return checks.select(F.concat("rules", extra).alias("rules"))


def report(checks: DataFrame, table: str, run_time: Column | None = None) -> DataFrame:
    """The report document of one table, from ``checked`` output: one row."""
    moment = F.current_timestamp() if run_time is None else run_time
    return checks.select(
        F.lit(table).alias("table"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("run_time"),
        F.col("rules"),
        F.forall("rules", lambda rule: rule["passed"]).alias("overall_passed"),
    )


#: Schema of report documents as they are read back, with the partition ``table``.
REPORT = "table string, run_time string, rules array<struct<rule:string,passed:boolean,fail_count:bigint,fail_pct:double,details:string>>, overall_passed boolean"


def failed_rules(reports: DataFrame) -> DataFrame:
    """One row per failed rule of each report."""
    failed = F.filter("rules", lambda rule: ~rule["passed"])
    return reports.select("table", "run_time", F.inline(failed))


def alerts(
    reports: DataFrame,
    environment: str | None = None,
    report_path: str = "N/A",
    execution_id: str = "N/A",
) -> DataFrame:
    """One message row per report with failed rules; none where every rule passed."""
    failed = F.filter("rules", lambda rule: ~rule["passed"])
    lines = F.transform(
        "failed",
        lambda rule: F.format_string(
            "%s | fail_count=%d | fail_pct=%s%% | %s",
            rule["rule"],
            rule["fail_count"],
            rule["fail_pct"].cast("string"),
            rule["details"],
        ),
    )
    tag = f"[{environment.upper()}]" if environment else "[ALERT]"
    return (
        reports.withColumn("failed", failed)
        .filter(F.size("failed") > 0)
        .select(
            F.col("table").alias("table_name"),
            "run_time",
            F.concat(F.lit(f"{tag} DQ Failure: "), F.col("table")).alias("subject"),
            F.size("failed").alias("failed_rules"),
            F.lit(report_path).alias("dq_report_path"),
            F.lit(execution_id).alias("execution_id"),
            F.concat_ws("\n", lines).alias("message"),
        )
    )
