"""Surrogate keys without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmart.sources.staging import stage


def dense_key(df: DataFrame, order_by: Sequence[str], output: str, start: int = 1) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in ``order_by`` order.

    ``order_by`` must be a unique key.  Rows are range-partitioned and sorted, each
    partition counts its own rows, and a running total over those counts, one row
    per partition, is added back.  The sorted rows are staged so that both reads
    see the same partitions.
    """
    position = F.monotonically_increasing_id()
    ordered = stage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns(
            {
                "_part": F.shiftright(position, 33),
                "_row": position.bitwiseAND((1 << 33) - 1),
            }
        ),
        "dense-key",
    )
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    key = F.col("_row") + F.col("_offset") + F.lit(start)
    return ordered.join(offsets, "_part").select(key.alias(output), *df.columns)


def stable_key(known: DataFrame | None, members: DataFrame, natural: Sequence[str], name: str) -> DataFrame:
    """The ``known`` keys and, numbered from the greatest of them on, those of new ``members``.

    A key once given never moves, whatever joins later; NULL is a value of a natural key
    like any other.  Columns are the natural key and ``name``.
    """
    unique = members.select(*natural).distinct()
    if known is None:
        return dense_key(unique, list(natural), name).select(*natural, F.col(name).cast("long").alias(name))
    held = known.select(*[F.col(c).alias(f"_{c}") for c in natural])
    new = unique.join(held, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural]), "left_anti")
    last = known.agg(F.coalesce(F.max(name), F.lit(0)).cast("long")).scalar()
    added = dense_key(new, list(natural), name).select(*natural, (F.col(name) + last).cast("long").alias(name))
    return known.select(*natural, F.col(name).cast("long").alias(name)).unionByName(added)
