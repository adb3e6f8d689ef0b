"""Time-bucketed metrics, alarms, log search and arrival events.

The windowed aggregates accept batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.functions.numeric import exact_avg, exact_sum

# The pattern of interesting log lines and the arrival filter.
ERROR_PATTERN = "ERROR|FAILED|Exception"
ARRIVAL_PREFIX = "raw/"
ARRIVAL_SUFFIX = ".csv"

ARRIVAL_EVENT = T.StructType(
    [
        T.StructField(
            "Records",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "s3",
                            T.StructType(
                                [
                                    T.StructField(
                                        "bucket", T.StructType([T.StructField("name", T.StringType())])
                                    ),
                                    T.StructField(
                                        "object",
                                        T.StructType(
                                            [
                                                T.StructField("key", T.StringType()),
                                                T.StructField("size", T.LongType()),
                                            ]
                                        ),
                                    ),
                                ]
                            ),
                        )
                    ]
                )
            ),
        )
    ]
)


def rollup(df: DataFrame, width: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum and mean of ``value`` per tumbling window and key."""
    return (
        df.groupBy(F.window(ts, width).alias("window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            exact_sum(F.col(value)).alias("sum_value"),
            exact_avg(F.col(value)).alias("avg_value"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "n", "sum_value", "avg_value")
    )


def alarms(
    df: DataFrame,
    signal: Column,
    width: str = "5 minutes",
    threshold: int = 1,
    keys: list[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Windows in which the sum of ``signal`` reaches ``threshold``."""
    keys = keys or []
    return (
        df.groupBy(F.window(ts, width).alias("window"), *keys)
        .agg(F.sum(signal).alias("total"))
        .filter(F.col("total") >= threshold)
        .select(F.col("window.start").alias("window_start"), *keys, "total")
    )


def status_counts(df: DataFrame, width: str, succeeded: Column, failed: Column, ts: str = "ts") -> DataFrame:
    """Successes and failures per window, side by side."""
    return (
        df.groupBy(F.window(ts, width).alias("window"))
        .agg(F.count_if(succeeded).alias("succeeded"), F.count_if(failed).alias("failed"))
        .select(F.col("window.start").alias("window_start"), "succeeded", "failed")
    )


def error_tail(df: DataFrame, message: str, ts: str, tie_break: str, limit: int = 20) -> DataFrame:
    """The newest log lines that mention an error: a top-k, not a sort."""
    return (
        df.filter(F.col(message).rlike(ERROR_PATTERN))
        .orderBy(F.col(ts).desc(), F.col(tie_break).desc())
        .limit(limit)
    )


def arrivals(df: DataFrame, event: str = "event") -> DataFrame:
    """Arrival events (JSON text) to one row per file; a missing size is 0."""
    files = df.withColumn("_record", F.explode(F.from_json(event, ARRIVAL_EVENT)["Records"]))
    return files.select(
        *[c for c in df.columns if c != event],
        F.col("_record.s3.bucket.name").alias("bucket"),
        F.col("_record.s3.object.key").alias("key"),
        F.coalesce(F.col("_record.s3.object.size"), F.lit(0)).alias("size"),
    )


def triggering(files: DataFrame, prefix: str = ARRIVAL_PREFIX, suffix: str = ARRIVAL_SUFFIX) -> DataFrame:
    """Only the files that start a load."""
    return files.filter(F.col("key").startswith(prefix) & F.col("key").endswith(suffix))
