"""Accounting of rows that a stream drops because they came after its watermark.

Spark counts them per stateful operator and micro-batch and then forgets them.  Here each
count becomes a small file named by query, batch and operator, so a batch reported twice,
by a listener and after the end or once more after a restart, counts once.

A deduplication counts rows.  A windowed aggregation adds up rows before its state sees
them, so it counts the late groups of every task: put ``drop_redelivered`` before it where
the number of rows matters.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fieldmart.sources import files

LATE = "query_id string, name string, batch_id bigint, operator int, operator_name string, watermark string, n_late bigint"


def _keep(spark: SparkSession, path: str, progress: dict) -> None:
    for k, operator in enumerate(progress.get("stateOperators") or []):
        n_late = operator.get("numRowsDroppedByWatermark", 0)
        if n_late > 0:
            row = {
                "query_id": progress["id"], "name": progress.get("name"), "batch_id": progress["batchId"], "operator": k,
                "operator_name": operator.get("operatorName"), "watermark": (progress.get("eventTime") or {}).get("watermark"), "n_late": n_late,
            }
            files.create(spark, f"{path}/{progress['id']}-{progress['batchId']:010d}-{k:03d}.json", json.dumps(row))


class LateRowListener(StreamingQueryListener):
    """Keeps the counts of every query of a session under ``path`` while they run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        """Nothing was dropped yet."""

    def onQueryProgress(self, event) -> None:
        _keep(self.spark, self.path, json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        """An idle trigger drops nothing."""

    def onQueryTerminated(self, event) -> None:
        """Batches were reported when they ended."""


def keep_recent(query: StreamingQuery, spark: SparkSession, path: str) -> None:
    """Keep the counts of a query's recent batches; for a query that ended without a listener.

    Spark remembers ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    for progress in query.recentProgress:
        _keep(spark, path, json.loads(progress.json))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Kept counts: a row per query, batch and operator that dropped late rows; none if none did."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], LATE)
    return spark.read.schema(LATE).option("pathGlobFilter", "*.json").json(path)
