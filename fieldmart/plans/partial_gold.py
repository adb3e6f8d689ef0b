"""Gold tables brought up to date from what changed in Silver, with the result of a rebuild.

A small state per table holds, for every Silver day, a print of its files and the least
and greatest values that scores are scaled with.  A run compares prints (a listing, no
data), reads the days that differ, and takes the extremes of the other days from the
state; so extremes that shrink because a row left are exact as well.

Unless the overall extremes moved, only these rows can change:

* rows of those days that differ from what Gold holds, and
* rows in one window group with such a row: the same retailer, or the same tehsil and week.

The first come from the changed days.  For the second, the columns that windows need are
read from Gold, for changed groups only, and worked out anew.  Partitions in which a value
really differs are then replaced; all others are left as they are.

The table is rebuilt as a whole when there is no state, when an extreme moved (every score
moves with it), when its columns changed, or when a former run ended half way: a run
leaves a marker before it touches the table and takes it away at the end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.functions import classify
from fieldmart.operators import scores, windows
from fieldmart.plans import gold
from fieldmart.schemas import GOLD_PARTITIONS, GOLD_TABLES
from fieldmart.sources import files
from fieldmart.sources.lake import NULL_PARTITION, in_partitions, location, read_optional, row_count, write_partitioned
from fieldmart.sources.staging import staged

DAY = "ingestion_date"

Bounds = Mapping[str, float | None]


@dataclass(frozen=True)
class Family:
    """Columns that depend on the rows of one window group."""

    group: tuple[str, ...]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    apply: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...]
    scaled: tuple[str, ...]
    score: Callable[[DataFrame, Bounds], DataFrame]
    families: tuple[Family, ...]
    rebuild: Callable[[DataFrame], DataFrame]

    @property
    def outputs(self) -> list[str]:
        return [name for family in self.families for name in family.outputs]

    @property
    def row_key(self) -> list[str]:
        return [*self.keys, *[p for p in GOLD_PARTITIONS if p not in self.keys]]


RETAILER_KPI = Table(
    "retailer_kpi",
    ("retailer_id", "week"),
    tuple(c for c in scores.RPS_WEIGHTS if c != "stockout_risk_flag"),
    lambda df, known: scores.retailer_priority(df, known).withColumn("visit_urgency", classify.VISIT_URGENCY.column()),
    (
        Family(("retailer_id",), ("week", "avg_weekly_revenue"), ("revenue_wow_pct",), windows.week_over_week_revenue),
        Family(("tehsil", "week"), ("rps_score",), ("top5_in_tehsil",), lambda df: windows.flag_top5_in_tehsil(df, stage_cut_offs=True)),
    ),
    lambda df: gold.retailer_kpi(df, stage_cut_offs=True),
)

DISTRICT_RISK = Table(
    "district_risk",
    ("district", "date"),
    ("total_pest_alerts",),
    lambda df, known: scores.district_risk(df, known).withColumns(
        {"risk_tier": classify.RISK_TIER.column(), "recommended_product": classify.RECOMMENDED_PRODUCT.column()}
    ),
    (
        Family(
            ("district",), ("date", "drs_score"), ("drs_7d_avg", "drs_trend"),
            lambda df: df.transform(windows.rolling_mean_rows).transform(windows.score_trend),
        ),
    ),
    gold.district_risk,
)

TABLES = {table.name: table for table in (RETAILER_KPI, DISTRICT_RISK)}


def _same(columns: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def _day(folder: str) -> str | None:
    value = unquote(folder.split("=", 1)[1])
    return None if value == NULL_PARTITION else value


def day_summaries(silver: DataFrame, days: Sequence[str | None], columns: Sequence[str]) -> dict[str | None, dict]:
    """Least and greatest value of each column on each of ``days``: one row per day."""
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        parts += [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
    found = silver.filter(in_partitions(DAY, days)).groupBy(F.col(DAY).cast("string").alias(DAY)).agg(*parts)
    return {row[DAY]: {c: row[c] for c in found.columns if c != DAY} for row in found.collect()}


def overall(days: Mapping[str | None, Mapping], columns: Sequence[str]) -> dict[str, float | None]:
    """Extremes over all days; NaN is greater than every number, as in Spark."""
    def order(value: float) -> tuple[bool, float]:
        return (value != value, 0.0 if value != value else value)

    out = {}
    for name in columns:
        for kind, pick in (("min", min), ("max", max)):
            values = [day[f"{kind}_{name}"] for day in days.values() if day.get(f"{kind}_{name}") is not None]
            out[f"{kind}_{name}"] = pick(values, key=order) if values else None
    return out


def _state(spark: SparkSession, path: str) -> dict | None:
    numbers = [n for n in files.names(spark, path) if n.isdigit()]
    return json.loads(files.read_text(spark, f"{path}/{max(numbers)}")) if numbers else None


def _save(spark: SparkSession, path: str, prints: Mapping, days: Mapping, bounds: Mapping) -> None:
    """Keep the state under the next number; older ones go."""
    numbers = sorted(n for n in files.names(spark, path) if n.isdigit())
    latest = int(numbers[-1]) if numbers else 0
    kept = [[day, prints[day], days.get(day, {})] for day in prints]
    files.create(spark, f"{path}/{latest + 1:010d}", json.dumps({"days": kept, "bounds": bounds}))
    for name in numbers:
        files.delete(spark, f"{path}/{name}")


def refresh(
    spark: SparkSession, table: Table, silver_path: str, gold_path: str, state_path: str, publish: bool = False
) -> dict:
    """Bring a Gold table up to date; ``mode`` (full, partial or unchanged) and ``rows`` written.

    Silver holds one row per key.  Without a Silver table nothing is done.  One run at a
    time may refresh a table.
    """
    silver_path = location(spark, silver_path)
    silver = read_optional(spark, silver_path)
    if silver is None:
        return {"mode": "unchanged", "rows": 0}
    prints = {_day(f): files.fingerprint_names(spark, f"{silver_path}/{f}") for f in files.subfolders(spark, silver_path) if f.startswith(f"{DAY}=")}
    state, marker = _state(spark, state_path), f"{state_path}/_running"
    known = {day: (mark, summary) for day, mark, summary in state["days"]} if state else {}
    changed = [day for day in {*prints, *known} if day not in prints or known.get(day, (None,))[0] != prints[day]]
    interrupted = files.exists(spark, marker)
    stored = read_optional(spark, gold_path)
    if state and stored is not None and not changed and not interrupted:
        return {"mode": "unchanged", "rows": 0}

    present = [day for day in changed if day in prints]
    days = {day: summary for day, (_, summary) in known.items() if day in prints}
    scaled = [c for c in table.scaled if c in silver.columns]
    days |= {day: {} for day in present} | (day_summaries(silver, present, scaled) if present else {})
    bounds = overall(days, scaled)
    files.create(spark, marker, "running")
    done = None
    # Equality of the texts also holds for NaN.
    if state and stored is not None and not interrupted and repr(state["bounds"]) == repr(bounds):
        done = _partial(table, silver, stored, location(spark, gold_path), changed, bounds)
    if done is None:
        done = {"mode": "full", **gold.write_gold(table.rebuild(silver), table.name, gold_path, publish)}
    _save(spark, state_path, prints, days, bounds)
    files.delete(spark, marker)
    return {"mode": done["mode"], "rows": done["rows"]}


def _differences(table: Table, fresh: DataFrame, held: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``_added`` telling which."""
    columns = fresh.columns
    sides = fresh.withColumn("_n", F.lit(1)).unionByName(held.select(*columns).withColumn("_n", F.lit(-1)))
    return sides.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n != 0").withColumn("_added", F.col("_n") > 0).drop("_n")


def _partial(
    table: Table, silver: DataFrame, stored: DataFrame, gold_path: str, changed: Sequence[str | None], bounds: Bounds
) -> dict | None:
    """Replace what changed; None if the columns differ, so that only a rebuild can tell."""
    fields = GOLD_TABLES[table.name].fieldNames()
    scored = table.score(silver.filter(in_partitions(DAY, changed)), bounds)
    fresh = scored.select(*[c for c in fields if c in scored.columns and c not in table.outputs])
    if {*fresh.columns, *table.outputs} != set(stored.columns):
        return None
    with (
        staged(_differences(table, fresh, stored.filter(in_partitions(DAY, changed))), "gold-changes") as changes,
        staged(_grouped(table, stored, changes), "gold-groups") as groups,
        staged(_updates(table, groups), "gold-updates") as updates,
    ):
        moved = changes.select(*GOLD_PARTITIONS).union(updates.filter("_differs").select(*GOLD_PARTITIONS)).distinct()
        # One row per replaced partition folder.
        parts = {(row[0], None if row[1] is None else str(row[1])) for row in moved.collect()}
        if not parts:
            return {"mode": "partial", "rows": 0}
        with staged(_replaced(table, stored, changes, updates, parts), "gold-partitions") as rows:
            written = write_partitioned(rows, gold_path, GOLD_PARTITIONS, measures=[row_count()])
            left = {(r[0], None if r[1] is None else str(r[1])) for r in rows.select(*GOLD_PARTITIONS).distinct().collect()}
        _drop_partitions(stored.sparkSession, gold_path, parts - left)
    return {"mode": "partial", "rows": written["rows"]}


def _held(table: Table, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored rows but for those that were removed or replaced."""
    gone = changes.filter("NOT _added").select(*table.row_key)
    return stored.join(gone, _same(table.row_key, stored, gone), "left_anti")


def _grouped(table: Table, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """All rows in changed groups, in the columns that windows need, with a flag per family."""
    outputs, first = table.outputs, {}
    for family in table.families:
        first |= dict.fromkeys([*family.group, *family.inputs])
    narrow = list(dict.fromkeys([*table.row_key, *first]))
    arriving = changes.filter("_added").select(*narrow, *[F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in outputs], F.lit(True).alias("_new"))
    rows = _held(table, stored.select(*narrow, *outputs), changes).withColumn("_new", F.lit(False)).unionByName(arriving)
    flags = []
    for i, family in enumerate(table.families):
        names = [f"_g{i}_{j}" for j in range(len(family.group))]
        groups = changes.select(*[F.col(c).alias(n) for c, n in zip(family.group, names, strict=True)]).distinct()
        match = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(family.group, names, strict=True)])
        rows = rows.join(groups.withColumn(f"_in{i}", F.lit(True)), match, "left").drop(*names)
        flags.append(F.coalesce(F.col(f"_in{i}"), F.lit(False)))
    return rows.filter(reduce(or_, flags)).withColumn("_before", F.struct(*outputs))


def _updates(table: Table, rows: DataFrame) -> DataFrame:
    """Window columns of these rows worked out anew, and whether they differ from the stored ones."""
    outputs = table.outputs
    for i, family in enumerate(table.families):
        inside = rows.filter(F.col(f"_in{i}")).drop(*family.outputs)
        outside = rows.filter(F.col(f"_in{i}").isNull())
        rows = family.apply(inside).unionByName(outside)
    differs = F.col("_new") | ~F.col("_before").eqNullSafe(F.struct(*outputs))
    return rows.select(*table.row_key, *outputs, differs.alias("_differs"))


def _replaced(
    table: Table, stored: DataFrame, changes: DataFrame, updates: DataFrame, parts: set[tuple[str | None, str | None]]
) -> DataFrame:
    """All rows of the partitions to replace, in the columns of the table."""
    states, days = ({p[i] for p in parts} for i in (0, 1))
    inside = in_partitions(GOLD_PARTITIONS[0], list(states)) & in_partitions(DAY, list(days))
    spark = stored.sparkSession
    chosen = spark.createDataFrame(sorted(parts, key=repr), "_state string, _day string")
    match = F.col(GOLD_PARTITIONS[0]).eqNullSafe(F.col("_state")) & F.col(DAY).cast("string").eqNullSafe(F.col("_day"))
    rows = _held(table, stored.filter(inside).join(chosen, match, "left_semi"), changes)
    rows = rows.unionByName(changes.filter("_added").drop("_added"), allowMissingColumns=True)
    names = {c: f"_u_{c}" for c in updates.columns}
    fresh = updates.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("_hit", F.lit(True))
    joined = rows.join(fresh, reduce(and_, [F.col(c).eqNullSafe(F.col(names[c])) for c in table.row_key]), "left")
    taken = {c: F.when(F.col("_hit"), F.col(names[c])).otherwise(F.col(c)) for c in table.outputs}
    return joined.withColumns(taken).select(*stored.columns)


def _drop_partitions(spark: SparkSession, path: str, parts: set[tuple[str | None, str | None]]) -> None:
    """Remove the folders of partitions that hold no row any more."""
    wanted = {tuple(NULL_PARTITION if v is None else v for v in part) for part in parts}
    for state in {state for state, _ in wanted}:
        for folder in files.subfolders(spark, path):
            if folder.startswith("state=") and unquote(folder.split("=", 1)[1]) == state:
                for day in (day for other, day in wanted if other == state):
                    files.delete(spark, f"{path}/{folder}/{DAY}={day}")
