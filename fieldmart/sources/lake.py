"""Parquet layers: partitioned writes, optional inputs, versioned tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.sources import files, stored_schema

# Fixed value: the folder in which Spark writes rows whose partition value is NULL.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def read_optional(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None where it does not exist.

    Of a published table the newest version is read.

    Without a ``schema`` the stored one counts (see ``stored_schema``), so a column that
    only newer files have is there for all rows and no footer is opened for it.  Only a
    table without a stored schema has the schemas of its files merged.

    Every other error, such as a broken file or a denied access, is raised.
    """
    path = location(spark, path)
    if not files.exists(spark, path):
        return None
    schema = schema or stored_schema.current(spark, path)
    try:
        return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    replace: str = "touched",
    measures: Sequence[Column] = (),
    gather: bool = True,
    keep_schema: bool = True,
) -> dict[str, int]:
    """Overwrite the ``touched`` partitions, those ``df`` has rows for, or ``all``, or ``publish``.

    A daily increment replaces what it touches and leaves other days alone.  A table
    rebuilt from its whole input replaces all, or a partition whose last row moved
    elsewhere would keep it.  While all is replaced in place a reader finds no table;
    ``publish`` writes the rows beside it as a new version, which counts once it is
    complete, and keeps the one before for readers that already planned on it.
    Touched partitions are replaced in the newest version.

    With ``gather`` one shuffle brings a partition's rows into few files (a rebalance
    hint), and adaptive execution cuts an oversized partition into several tasks, so
    a state with a third of all rows is not written by a single task.  Rows that all
    belong to one partition need no gathering.

    With ``keep_schema`` the table's stored schema takes in the columns of ``df`` before
    they are written; a table replaced as a whole gets the schema of ``df``.

    ``measures`` are aggregates observed by the write itself.  They are taken in the
    writing stage, whose tasks count once even when an executor is lost.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if gather else df
    spark, seen = df.sparkSession, Observation()
    if measures:
        rows = rows.observe(seen, *measures)
    table, version = path, None
    if replace == "touched":
        path = location(spark, table)
    elif replace == "publish":
        version = _claim_version(spark, table)
        path = _version_path(table, version)
    if keep_schema and replace == "touched":
        stored_schema.evolve(spark, path, df.schema)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if replace == "touched" else "static")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    if keep_schema and replace != "touched":
        stored_schema.evolve(spark, path, df.schema)
    if version is not None:
        _commit_version(spark, table, version)
        drop_old_versions(spark, table)
    return dict(seen.get) if measures else {}


def in_partitions(column: str, values: Sequence) -> Column:
    """Rows of the named partitions; None names the folder of rows without a value."""
    test = F.col(column).isin([value for value in values if value is not None])
    return test | F.col(column).isNull() if None in values else test


def row_count() -> Column:
    return F.count(F.lit(1)).alias("rows")


def latest_partition(df: DataFrame, column: str = "ingestion_date") -> DataFrame:
    """Only the rows of the newest ``column`` value, found by a scalar subquery."""
    newest = df.agg(F.max(column).alias("newest")).scalar()
    return df.filter(F.col(column) == newest)


class VersionConflict(RuntimeError):
    """Another writer committed a version since the one this write was worked out from."""


def _version_folders(spark: SparkSession, path: str) -> list[int]:
    """Version numbers with a folder, newest first, committed or not."""
    names = [n for n in files.subfolders(spark, path) if n.startswith("v") and n[1:].isdigit()]
    return sorted((int(name[1:]) for name in names), reverse=True)


def _version_path(path: str, version: int) -> str:
    return f"{path}/v{version:010d}"


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the small files in ``_claims`` or ``_commits``, newest first."""
    return sorted((int(n) for n in files.names(spark, f"{path}/{kind}") if n.isdigit()), reverse=True)


def versions(spark: SparkSession, path: str) -> Iterator[int]:
    """Committed versions of a versioned table, newest first.

    A commit is a small numbered file that names a version and that only one writer can
    create, so a version being written, or left by a failed writer, is never read.
    """
    for commit in _numbers(spark, path, "_commits"):
        yield int(files.read_text(spark, f"{path}/_commits/{commit:010d}"))


def location(spark: SparkSession, path: str) -> str:
    """The folder of the newest version of a published table; ``path`` itself for any other."""
    newest = next(versions(spark, path), None)
    return path if newest is None else _version_path(path, newest)


def read_version(
    spark: SparkSession, path: str, version: int | None = None, schema: T.StructType | None = None
) -> DataFrame | None:
    """One version of the table, the newest by default; None before the first write."""
    chosen = next(versions(spark, path), None) if version is None else version
    if chosen is None:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(_version_path(path, chosen))


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` newest committed versions; readers of those stay safe.

    Commits go before the folders they name, so no reader is sent to a folder that is
    being deleted.  The newest claim stays, or its number could be given again.
    """
    commits = _numbers(spark, path, "_commits")[max(keep, 1):]
    old = [int(files.read_text(spark, f"{path}/_commits/{commit:010d}")) for commit in commits]
    for commit, version in zip(commits, old, strict=True):
        files.delete(spark, f"{path}/_commits/{commit:010d}")
        files.delete(spark, _version_path(path, version))
        files.delete(spark, f"{path}/_claims/{version:010d}")
    return old


def _claim_version(spark: SparkSession, path: str) -> int:
    """A version number that no other writer has or will get."""
    while True:
        taken = [*_version_folders(spark, path)[:1], *_numbers(spark, path, "_claims")[:1]]
        version = max(taken, default=0) + 1
        if files.create(spark, f"{path}/_claims/{version:010d}", "claimed"):
            return version


def _commit_version(spark: SparkSession, path: str, version: int, based_on: int | None = None) -> None:
    """Make ``version`` the newest; with ``based_on`` only as the direct successor of that one (0: of none)."""
    while True:
        commit = next(iter(_numbers(spark, path, "_commits")), 0)
        newest = int(files.read_text(spark, f"{path}/_commits/{commit:010d}")) if commit else 0
        if based_on is not None and newest != based_on:
            files.delete(spark, _version_path(path, version))
            raise VersionConflict(f"version {newest} of {path} was committed after version {based_on} was read")
        if files.create(spark, f"{path}/_commits/{commit + 1:010d}", str(version)):
            return


def write_version(df: DataFrame, path: str, based_on: int | None = None) -> int:
    """Write ``df`` as the next version and return its number.

    The version being read is left untouched, so a frame may be derived from the
    table it replaces, and a failed write changes nothing for readers.  With ``based_on``,
    the version ``df`` was derived from (0 for none), VersionConflict is raised instead of
    undoing what another writer committed in between.
    """
    version = _claim_version(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(_version_path(path, version))
    _commit_version(df.sparkSession, path, version, based_on)
    return version
