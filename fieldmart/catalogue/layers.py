"""Silver and Gold tables derived from the given tables, written once per session.

Business queries, loads and catalog tables read a Gold table that exists, as they
would in a lake; the Gold queries themselves compute from Silver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldmart.catalogue import views
from fieldmart.plans import gold, silver
from fieldmart.schemas import GOLD_PARTITIONS, GOLD_TABLES
from fieldmart.session import configure
from fieldmart.sources import catalog, files
from fieldmart.sources.staging import fresh_path

Key = tuple[str, str, str, str]

_written: dict[Key, str] = {}
_schemas: dict[Key, T.StructType] = {}


def forget() -> None:
    """Build every table anew on next use."""
    _written.clear()
    _schemas.clear()


def _key(spark: SparkSession, sf_dir: str, name: str) -> Key:
    """A table belongs to one application and one state of its input files."""
    return spark.sparkContext.applicationId, sf_dir, files.fingerprint(spark, sf_dir), name


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = _key(spark, sf_dir, name)
    if key not in _written:
        path = fresh_path(configure(spark), name)
        write(path)
        _written[key] = path
    return _written[key]


def _silver(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Silver table ``name``, written by ``build`` on first use."""
    key = _key(spark, sf_dir, name)

    def write(path: str) -> None:
        frame = build()
        frame.write.parquet(path)
        _schemas[key] = frame.schema

    path = _once(spark, sf_dir, name, write)
    return spark.read.schema(_schemas[key]).parquet(path)


def silver_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(
        spark, sf_dir, "silver_retailer", lambda: silver.type_retailers(views.retailer_weeks(spark, sf_dir))
    )


def silver_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(
        spark, sf_dir, "silver_district", lambda: silver.type_districts(views.district_days(spark, sf_dir))
    )


def silver_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        # An inventory row has one retailer, so its lines can be enriched before they are summed.
        lines = silver.enrich_inventory(views.sold_lines(spark, sf_dir), views.retailers(spark, sf_dir))
        frame = silver.type_demand(views.stock_of(lines, ["district", "state"]))
        frame = frame.withColumn("ingestion_date", frame["week"].cast("date"))
        return frame.withColumn("ingestion_timestamp", frame["ingestion_date"].cast("timestamp"))

    return _silver(spark, sf_dir, "silver_demand", build)


def computed_gold(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Gold table as a plan over Silver."""
    if table == "retailer_kpi":
        return gold.retailer_kpi(silver_retailers(spark, sf_dir), strict=True, stage_cut_offs=True)
    if table == "district_risk":
        return gold.district_risk(silver_districts(spark, sf_dir), strict=True)
    return gold.demand_forecast(gold.demand_series(silver_demand(spark, sf_dir)), strict=True)


def gold_path(spark: SparkSession, sf_dir: str, table: str) -> str:
    return _once(
        spark, sf_dir, f"gold-{table}",
        lambda path: gold.write_gold(computed_gold(spark, sf_dir, table), table, path),
    )


def _database(path: str) -> str:
    return "fieldmart_" + path.rsplit("-", 1)[1]


def gold_table(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Name of the external catalog table over the written Gold table."""
    location = gold_path(spark, sf_dir, table)

    def register(path: str) -> None:
        catalog.create_database(spark, _database(path), path)
        catalog.register_external(
            spark, f"{_database(path)}.{table}", GOLD_TABLES[table], GOLD_PARTITIONS, location
        )

    path = _once(spark, sf_dir, f"catalog_{table}", register)
    return f"{_database(path)}.{table}"


def stored_gold(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The written Gold table, read through the catalog.

    The catalog knows the (state, day) partitions, so a query on one day lists only
    that day's folders however many the table has.
    """
    return spark.table(gold_table(spark, sf_dir, table))
