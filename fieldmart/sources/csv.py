"""CSV discovery and scan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.sources import files

CORRUPT_RECORD = "_corrupt_record"


def discover(spark: SparkSession, root: str, exported: Collection[str] = ()) -> DataFrame:
    """CSV files under ``root``: dataset, path, size, modified.

    The dataset is the file stem.  A file in a folder named in ``exported`` whose own
    stem is not named there is a part of that folder's dataset, as jobs export them.
    Only names and sizes are listed; contents are not read.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    return route(found, exported)


def route(found: DataFrame, exported: Collection[str] = ()) -> DataFrame:
    """Adds the dataset that each file belongs to, by its ``path``."""
    stem = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    names = list(exported)
    part = folder.isin(names) & ~stem.isin(names) if names else F.lit(False)
    return found.select(F.when(part, folder).otherwise(stem).alias("dataset"), "path", "size", "modified")


def header_groups(spark: SparkSession, paths: Collection[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header; one line of each file is read."""
    groups = defaultdict(list)
    for path, header in files.first_records(spark, paths).items():
        groups[tuple(header)].append(path)
    return dict(groups)


def column_names(header: Sequence[str], known: Collection[str], aliases: Mapping[str, str]) -> list[str]:
    """A name for every column of a header, no two of them equal but for case.

    Blanks around a name and its case do not count when it is matched with ``known``
    names and ``aliases``; an alias gives way where the header has the column itself.  Of
    several columns of one name the first keeps it, later ones get their position added.
    """
    own = {name.lower(): name for name in known}
    other = {alias.lower(): name for alias, name in aliases.items() if name in known}
    bare = [name.strip() for name in header]
    there = {name.lower() for name in bare}
    taken: set[str] = set()
    out = []
    for place, name in enumerate(bare):
        low = name.lower()
        meant = own.get(low) or (other[low] if low in other and other[low].lower() not in there else None) or name or f"_c{place}"
        while meant.lower() in taken:
            meant = f"{meant}_{place}"
        taken.add(meant.lower())
        out.append(meant)
    return out


def read(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, **options) -> DataFrame:
    """Scan CSV with a header.

    With a schema, a row that does not fit is kept and its text goes to
    ``_corrupt_record``; without one the types are inferred from the file.
    """
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if CORRUPT_RECORD not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT_RECORD, T.StringType())])
    return (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_RECORD)
        .csv(path)
    )


def read_by_header(
    spark: SparkSession, paths: Collection[str], schema: T.StructType, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """Scan files whose headers may differ: columns are matched by name.

    A column may come in any place, in any case or under an alias (see ``column_names``),
    columns the schema lacks are kept as text, and columns a file lacks are NULL.
    """
    aliases, kinds = aliases or {}, {f.name: f.dataType for f in schema.fields}
    frames = []
    for header, group in header_groups(spark, paths).items():
        columns = column_names(header, kinds, aliases)
        fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in columns]
        # Names were matched above; Spark only has to take the columns in their order.
        frame = read(spark, [files.literal_path(p) for p in group], T.StructType(fields), enforceSchema=True)
        missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in columns}
        extra = [f"`{c}`" for c in columns if c not in kinds]
        frame = frame.withColumns({**missing, "source_path": F.col("_metadata.file_path")})
        frames.append(frame.select(*kinds, *extra, CORRUPT_RECORD, "source_path"))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
