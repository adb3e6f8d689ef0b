"""Delete-matched and upsert as joins; Parquet tables have no row-level DELETE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.operators.windows import keep_latest


def delete_matched(target: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not in ``staging``; NULL keys never match.

    Staging keys are made distinct first, so a hot key reaches the join once.
    """
    return target.join(staging.select(*keys).distinct(), list(keys), "left_anti")


def upsert(target: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace matched rows by the staged ones and add the rest.

    Every staged row is kept; a column that only one side has is NULL for the other's rows.
    """
    kept = delete_matched(target, staging, keys).select(target.columns)
    return kept.unionByName(staging, allowMissingColumns=True)


def upsert_latest(target: DataFrame, staging: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """Upsert that compares: per key the row with the greatest ``order_by`` stays.

    A staged row wins a tie, so a delivery made again changes nothing, and a NULL loses
    to any value.  Rows with a NULL in their key match nothing and are all kept.
    """
    both = target.withColumn("_staged", F.lit(0)).unionByName(staging.withColumn("_staged", F.lit(1)), allowMissingColumns=True)
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    newest = keep_latest(both.filter(keyed), keys, order_by, ["_staged", *[c for c in both.columns if c not in (*keys, order_by, "_staged") and _sortable(both, c)]])
    return newest.unionByName(both.filter(~keyed)).drop("_staged")


def _sortable(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.AtomicType)


def append_by_name(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert with a column list: matched by name, the rest NULL."""
    names = [c for c in target.columns if c in rows.columns]
    return target.unionByName(rows.select(names), allowMissingColumns=True)
