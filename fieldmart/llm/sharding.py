"""Operator 10: vector bin packing of documents into shards.

Bytes, tokens and rows are balanced together.  Documents of equal text form a group
and stay together.  A group that holds more than 1/``cells`` of any of the three totals
(at most 3 * ``cells`` groups can) is a unit of its own; lighter groups are gathered
into ``cells`` units by the hash of their text.  Only a group larger than a whole shard
is split, by document, since no shard could hold it.  The units, a table of bounded
size, are placed one by one, largest first: of the shards with room for the unit, the
one whose residual capacity has the highest dot product with it; if none has room, the
one that ends up least overfull.

Defined results: null and empty texts are equal and have size 1; repeated rows get a
slot each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmart.llm.frames import input_columns, numbered
from fieldmart.sources.staging import stage

SHARDS = 16
CELLS = 4096
#: Parts per shard's worth of a group that must be split.
SPLIT = 32
DIMENSIONS = ("size", "tokens", "rows")


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unit (rows of bytes, tokens, rows), by dot product with what is left."""
    total = units.sum(axis=0)
    weight = units / np.maximum(total / shards, 1e-9)  # in shards' worth
    left = np.ones((shards, units.shape[1]))
    out = np.zeros(len(units), np.int64)
    for u in np.lexsort((np.arange(len(units)), -weight.max(axis=1))):
        after = left - weight[u]
        fits = (after >= 0).all(axis=1)
        if fits.any():
            shard = int(np.argmax(np.where(fits, left @ weight[u], -np.inf)))
        else:
            shard = int(np.argmax(after.min(axis=1)))
        left[shard] = after[shard]
        out[u] = shard
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, rows and group of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return input_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.xxhash64(text, F.length(text)).alias("group"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard for every document."""
    spark = docs.sparkSession
    sized = stage(measured(docs), "sized")
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    totals = sized.agg(*sums).first()
    share = {d: max(1.0, (totals[d] or 0) / shards) for d in DIMENSIONS}
    over = lambda parts: F.greatest(*[F.col(d) / (share[d] * parts) for d in DIMENSIONS])
    large = (
        sized.groupBy("group").agg(*sums)
        .filter(over(shards / cells) > 1)
        .select(
            F.col("group").alias("large"),
            F.when(over(1.0) > 1, F.ceil(over(1.0) * SPLIT)).otherwise(1).cast("int").alias("parts"),
        )
    )
    # At most 3 * cells groups can each hold more than 1 / cells of a total.
    large = F.broadcast(stage(large, "large-groups"))
    marked = sized.join(large, F.col("group") == F.col("large"), "left").select(
        *sized.columns,
        F.col("large").isNotNull().alias("own"),
        F.coalesce("large", F.pmod("group", F.lit(cells))).alias("unit"),
        F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")), F.lit(0)).cast("int").alias("part"),
    )
    units = marked.groupBy("own", "unit", "part").agg(*sums).orderBy("own", "unit", "part").collect()  # bounded as above
    chosen = place(np.array([[r[d] for d in DIMENSIONS] for r in units], float).reshape(-1, 3), shards)
    plan = spark.createDataFrame(
        [(r["own"], r["unit"], r["part"], int(s)) for r, s in zip(units, chosen, strict=True)],
        "p_own boolean, p_unit long, p_part int, shard int",
    )
    placed = marked.join(
        F.broadcast(plan),
        (F.col("own") == F.col("p_own")) & (F.col("unit") == F.col("p_unit")) & (F.col("part") == F.col("p_part")),
    ).select("doc_id", "size", "tokens", "text_crc32", "shard")
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    return numbered(placed, "shard", order, "slot").select(
        "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
