"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(date: Column) -> Column:
    """ISO week label such as ``2026-W20``; zero padded, so it sorts by time."""
    year = F.extract(F.lit("YEAROFWEEK"), date).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def as_order_key(column: str, data_type: str) -> Column:
    """Seconds since the epoch for date-like columns, so text dates sort by time."""
    value = F.col(column)
    if data_type == "string":
        value = value.try_cast("timestamp")
    return F.unix_seconds(value.cast("timestamp"))
