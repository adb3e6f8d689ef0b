"""Projection helpers that look at the schema while the plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmart.functions.numeric import to_number


class MissingColumns(ValueError):
    """A strict projection asked for columns the input does not have."""


def project(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Select ``columns`` in order; absent ones are dropped, or raise if ``strict``."""
    absent = [c for c in columns if c not in df.columns]
    if strict and absent:
        raise MissingColumns(f"missing columns: {', '.join(absent)}")
    return df.select([c for c in columns if c in df.columns])


def first_existing(df: DataFrame, *names: str) -> str:
    """The first of ``names`` that is a column of ``df``."""
    for name in names:
        if name in df.columns:
            return name
    raise MissingColumns(f"none of {', '.join(names)} is present")


def typed(
    df: DataFrame, types: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Cast columns to ``types``; ``aliases`` lists alternative raw names, best first."""
    aliases = aliases or {}
    source_types = dict(df.dtypes)
    casts: dict[str, Column] = {}
    for name, target in types.items():
        source = first_existing(df, *aliases.get(name, ()), name)
        casts[name] = to_number(F.col(source), source_types[source], target)
    return df.withColumns(casts)


def with_default(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name`` only where the input lacks it."""
    return df if name in df.columns else df.withColumn(name, value)


def narrow(df: DataFrame, spec: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Project to ``(name, type, default)`` triples with non-raising casts.

    A value that does not fit becomes NULL; a NULL takes the default if there is one.
    ``misfits`` names the values that do not fit, so that their rows can be turned away.
    """
    source_types = dict(df.dtypes)
    out = []
    for name, target, default in spec:
        if name in source_types:
            value = to_number(F.col(name), source_types[name], target)
            if default is not None:
                value = F.coalesce(value, F.lit(default).cast(target))
        else:
            value = F.lit(default).cast(target)
        out.append(value.alias(name))
    return df.select(out)


def lost_values(df: DataFrame, spec: Sequence[tuple[str, str, object]]) -> dict[str, Column]:
    """By column, whether ``narrow`` would lose a row's value; NaN stands for a missing one."""
    source_types = dict(df.dtypes)
    found = {}
    for name, target, _ in spec:
        if name in source_types and source_types[name] != target:
            value = F.col(name)
            found[name] = value.isNotNull() & to_number(value, source_types[name], target).isNull()
            if source_types[name] in ("double", "float"):
                found[name] &= ~F.isnan(value)
    return found


def misfits(df: DataFrame, spec: Sequence[tuple[str, str, object]]) -> Column:
    """Array of (name, reason), one for every value that ``narrow`` would lose."""
    targets = {name: target for name, target, _ in spec}
    marks = [
        F.when(lost, F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"{name} does not fit {targets[name]}: "), F.col(name).cast("string")).alias("reason")))
        for name, lost in lost_values(df, spec).items()
    ]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<struct<name:string,reason:string>>")
