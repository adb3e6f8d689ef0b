"""Composite scores built on whole-table minima and maxima.

The extremes come from one scalar subquery: a map-side combined aggregate whose
single row Spark folds into the scoring projection.  Nothing is collected and no
join is planned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmart.functions.numeric import weighted_sum

# Score weights.
RPS_WEIGHTS = {
    "avg_weekly_revenue": 0.30,
    "days_since_last_visit": 0.25,
    "stockout_events": 0.20,
    "stockout_risk_flag": 0.15,
    "avg_depletion_rate": 0.10,
}
DRS_WEIGHTS = {
    "total_pest_alerts": 0.35,
    "fungicide_risk_flag": 0.30,
    "high_humidity_flag": 0.20,
    "drought_stress_flag": 0.15,
}


BOUNDS = "_bounds"


def with_extremes(
    df: DataFrame, columns: Sequence[str], known: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Add ``_bounds``, a struct of ``min_<c>`` and ``max_<c>`` per column.

    The subquery appears once in the plan, however many scores read its fields.  With
    ``known``, extremes of the whole table, none is planned and ``df`` may be a part of it.
    """
    if known is not None:
        names = [f"{kind}_{c}" for c in columns for kind in ("min", "max")]
        return df.withColumn(BOUNDS, F.struct(*[F.lit(known.get(n)).cast("double").alias(n) for n in names]))
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        parts += [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
    return df.withColumn(BOUNDS, df.agg(F.struct(*parts).alias("extremes")).scalar())


def _filled_max(name: str) -> Column:
    """The maximum, with NULL and 0 both read as 1."""
    return F.coalesce(F.nullif(F.col(f"{BOUNDS}.max_{name}"), F.lit(0.0)), F.lit(1.0))


def scaled_to_unit(name: str) -> Column:
    """(x - min) / (max - min); a missing minimum is 0, a zero span is 1."""
    low = F.coalesce(F.col(f"{BOUNDS}.min_{name}"), F.lit(0.0))
    span = _filled_max(name) - low
    return (F.col(name) - low) / F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0))


def min_max_norm(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add min-max normalised columns, given as ``{source: alias}``, in one pass."""
    scaled = {alias: scaled_to_unit(name) for name, alias in columns.items()}
    return with_extremes(df, list(columns)).withColumns(scaled).drop(BOUNDS)


def retailer_priority(df: DataFrame, known: Mapping[str, float | None] | None = None) -> DataFrame:
    """``rps_score``: weighted, min-max normalised visit priority in [0, 1]."""
    flag = "stockout_risk_flag"
    terms = [
        (weight, F.col(name).cast("double") if name == flag else scaled_to_unit(name))
        for name, weight in RPS_WEIGHTS.items()
    ]
    scored = with_extremes(df, [c for c in RPS_WEIGHTS if c != flag], known)
    return scored.withColumn("rps_score", F.round(weighted_sum(terms), 4)).drop(BOUNDS)


def district_risk(df: DataFrame, known: Mapping[str, float | None] | None = None) -> DataFrame:
    """``drs_score``: weighted crop-risk score; pest alerts are scaled by their maximum."""
    pest = "total_pest_alerts"
    terms = [
        (weight, F.col(name) / _filled_max(name) if name == pest else F.col(name).cast("double"))
        for name, weight in DRS_WEIGHTS.items()
    ]
    scored = with_extremes(df, [pest], known)
    return scored.withColumn("drs_score", F.round(weighted_sum(terms), 4)).drop(BOUNDS)
