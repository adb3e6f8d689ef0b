"""Session settings shared by jobs, queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A small shuffle may still open hundreds of partition folders on write, so it
    # keeps all cores busy; large shuffles never come near this floor.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Rows of the layers shrink more than tenfold in a shuffle, so Spark's 64 MB would
    # unfold to over 1 GB where a task sorts two sides and aggregates.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join partitions even where that costs one more exchange: a
    # single district or retailer may hold a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "fieldmart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or fetch a session.

    ``shuffle_partitions`` is the starting number of shuffle partitions; adaptive
    execution merges small ones, so a cluster job should start high (two to three
    times its cores, or shuffle bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
