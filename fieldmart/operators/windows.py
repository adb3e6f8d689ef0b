"""Window operators.

Windows here partition by an entity (retailer, district, SKU x district) whose
rows are unique per period, so a partition is no longer than the calendar.  The
one group without such a bound, retailers of a tehsil in a week, is ranked
without a window over the whole group: see ``flag_top_k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldmart.functions.calendar import as_order_key
from fieldmart.functions.numeric import safe_percent_change
from fieldmart.sources.staging import stage


def period_column(df: DataFrame, preferred: str) -> str:
    """``preferred`` where present, else the ingestion date."""
    return preferred if preferred in df.columns else "ingestion_date"


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def keep_latest(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str = "ingestion_timestamp",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the newest row per key; NULL is a key value like any other.

    Ties are broken on every other column, so the survivor does not depend on row
    order.  Spark limits each group to one row inside the map tasks before the
    shuffle, so a key that holds a third of the input never meets in one task.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    if order_by not in df.columns:
        df = df.withColumn(order_by, F.lit("1970-01-01"))
    if tie_break is None:
        tie_break = [
            f.name
            for f in df.schema.fields
            if f.name not in keys and f.name != order_by and _orderable(f.dataType)
        ]
    order = [F.col(c).desc_nulls_last() for c in (order_by, *tie_break)]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def week_over_week_revenue(df: DataFrame, key: str = "retailer_id") -> DataFrame:
    """``revenue_wow_pct``: change against the same retailer's previous row."""
    window = Window.partitionBy(key).orderBy(period_column(df, "week"))
    previous = F.lag("avg_weekly_revenue", 1).over(window)
    return (
        df.withColumn("_previous", previous)
        .withColumn("revenue_wow_pct", safe_percent_change(F.col("avg_weekly_revenue"), F.col("_previous")))
        .drop("_previous")
    )


def flag_top_k(
    df: DataFrame,
    group: Sequence[str],
    score: str = "rps_score",
    k: int = 5,
    output: str = "top5_in_tehsil",
    stage_cut_offs: bool = False,
) -> DataFrame:
    """1 where ``rank() over (group order by score desc) <= k``, else 0.

    A row ranks within k exactly when fewer than k rows score higher, that is, when
    its score reaches the k-th highest of the group.  So only that cut-off is
    computed: k rows per group leave each map task (a window group limit), and the
    cut-offs, one row per group, are joined back.  No task sees a whole group, and
    adaptive execution splits a hot group on the join.

    ``stage_cut_offs`` writes the cut-offs first.  Spark then plans the join from their
    true size: below its broadcast limit the rows of ``df`` are not shuffled at all.
    """
    names = {g: f"_cut_{i}" for i, g in enumerate(group)}
    window = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last())
    cut_offs = (
        df.select(*group, score)
        .withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= k)
        .groupBy(*[F.col(g).alias(alias) for g, alias in names.items()])
        .agg(F.count(score).alias("_scored"), F.min(score).alias("_cut_off"))
    )
    if stage_cut_offs:
        cut_offs = stage(cut_offs, "cut-offs")
    match: Column = F.lit(True)
    for name, alias in names.items():
        match = match & F.col(name).eqNullSafe(F.col(alias))
    within = (F.col("_scored") < k) | (F.col(score) >= F.col("_cut_off"))
    return (
        df.join(cut_offs, match, "left")
        .withColumn(output, F.when(within, 1).otherwise(0))
        .drop(*names.values(), "_scored", "_cut_off")
    )


def flag_top5_in_tehsil(df: DataFrame, stage_cut_offs: bool = False) -> DataFrame:
    """Flag the five best scores per tehsil and week; equal scores share a rank."""
    period = [c for c in ("week", "ingestion_date") if c in df.columns][:1]
    return flag_top_k(df, ["tehsil", *period], stage_cut_offs=stage_cut_offs)


def rolling_mean_rows(
    df: DataFrame,
    value: str = "drs_score",
    key: str = "district",
    rows: int = 7,
    output: str = "drs_7d_avg",
) -> DataFrame:
    """Mean of the current and the ``rows - 1`` preceding rows of the key."""
    order = period_column(df, "date")
    window = (
        Window.partitionBy(key)
        .orderBy(as_order_key(order, dict(df.dtypes)[order]))
        .rowsBetween(-(rows - 1), 0)
    )
    return df.withColumn(output, F.round(F.avg(value).over(window), 4))


def rolling_mean_days(
    df: DataFrame,
    value: str = "drs_score",
    key: str = "district",
    days: int = 7,
    output: str = "drs_7d_avg",
) -> DataFrame:
    """Mean over the last ``days`` calendar days, gaps included."""
    order = period_column(df, "date")
    window = (
        Window.partitionBy(key)
        .orderBy(as_order_key(order, dict(df.dtypes)[order]))
        .rangeBetween(-(days - 1) * 86400, 0)
    )
    return df.withColumn(output, F.round(F.avg(value).over(window), 4))


def score_trend(
    df: DataFrame,
    value: str = "drs_score",
    key: str = "district",
    threshold: float = 0.05,
    output: str = "drs_trend",
) -> DataFrame:
    """UP, DOWN or STABLE against the key's previous row; the first row is STABLE."""
    order = period_column(df, "date")
    window = Window.partitionBy(key).orderBy(as_order_key(order, dict(df.dtypes)[order]))
    delta = F.col(value) - F.col("_previous")
    label = (
        F.when(F.col("_previous").isNull(), "STABLE")
        .when(delta > threshold, "UP")
        .when(delta < -threshold, "DOWN")
        .otherwise("STABLE")
    )
    return df.withColumn("_previous", F.lag(value, 1).over(window)).withColumn(output, label).drop("_previous")


def moving_average(
    df: DataFrame,
    value: str = "actual_qty",
    keys: Sequence[str] = ("sku_id", "district"),
    rows: int = 4,
    output: str = "ma_4w",
) -> DataFrame:
    """Mean of the current and the ``rows - 1`` preceding weeks of the series."""
    window = Window.partitionBy(*keys).orderBy("week").rowsBetween(-(rows - 1), 0)
    return df.withColumn(output, F.round(F.avg(value).over(window), 2))


def trend_slope(
    df: DataFrame,
    value: str = "actual_qty",
    keys: Sequence[str] = ("sku_id", "district"),
    lag: int = 4,
    output: str = "trend_slope",
) -> DataFrame:
    """Average change per week against ``lag`` rows ago; 0 without a non-zero base."""
    window = Window.partitionBy(*keys).orderBy("week")
    slope = F.round((F.col(value) - F.col("_base")) / float(lag), 2)
    return (
        df.withColumn("_base", F.lag(value, lag).over(window))
        .withColumn(output, F.when(F.col("_base") != 0, slope).otherwise(0.0))
        .drop("_base")
    )
