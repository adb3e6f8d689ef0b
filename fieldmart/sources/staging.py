"""Intermediate tables in the shared folder the cluster names.

A frame that several branches of a plan read is written once as Parquet and read
back: the branches then scan only the columns they need, and a lost executor
costs nothing but its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fieldmart.sources import files

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file:" + tempfile.mkdtemp(prefix="fieldmart-", dir="/tmp")
    return _local_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/fieldmart/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it."""
    return _written(df, fresh_path(df.sparkSession, name))


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stage`` for the length of a block; the folder goes once the block succeeded.

    When the block fails the folder stays, since it may hold the only full copy of
    what was being replaced.
    """
    path = fresh_path(df.sparkSession, name)
    yield _written(df, path)
    files.delete(df.sparkSession, path)
