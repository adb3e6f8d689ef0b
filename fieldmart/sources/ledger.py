"""A ledger: rows appended in numbered commits, each of which counts as a whole or not at all.

Rows of a commit are a Parquet folder of their own.  The commit itself is a small file
that names the folder, created only if its number is free, so of two writers one takes
the next number and the other sees what it missed before it tries again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldmart.sources import files


class Conflict(RuntimeError):
    """Another writer committed something that rules this commit out."""


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Commit number -> entry name, in order."""
    found = {int(n): files.read_text(spark, f"{path}/commits/{n}").strip() for n in files.names(spark, f"{path}/commits") if n.isdigit()}
    return dict(sorted(found.items()))


def entries(spark: SparkSession, path: str) -> set[str]:
    """Names of all committed entries."""
    return set(commits(spark, path).values())


def read(spark: SparkSession, path: str, schema: T.StructType, since: int = 0) -> DataFrame:
    """Rows of all commits with a number above ``since``, with the name of their ``entry``."""
    named = [f"{path}/entries/entry={name}" for number, name in commits(spark, path).items() if number > since]
    full = T.StructType([*schema.fields, T.StructField("entry", T.StringType())])
    if not named:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/entries").parquet(*named)


def append(
    rows: DataFrame, path: str, entry: str | None = None, check: Callable[[int], None] | None = None
) -> str:
    """Commit ``rows`` under the name ``entry`` and return it.

    ``check`` is called with the number of the last commit seen, whenever others came
    between, and raises Conflict if the commit may not be made after them.
    """
    spark = rows.sparkSession
    entry = entry or uuid.uuid4().hex
    last = max(commits(spark, path), default=0)
    rows.write.mode("overwrite").parquet(f"{path}/entries/entry={entry}")
    while not files.create(spark, f"{path}/commits/{last + 1:010d}", entry):
        if check:
            check(last)
        last = max(commits(spark, path), default=0)
    return entry
