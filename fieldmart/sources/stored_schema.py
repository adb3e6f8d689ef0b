"""The schema of a table as a small file beside its data.

A reader takes columns and types from it instead of opening the footers of all files, so
reading one day of a table costs one day, however long its history is.  A writer adds its
new columns and wider types before it writes; older files then read as NULL there.
Each state of the schema is a numbered file that only one writer can create.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from fieldmart.sources import files

FOLDER = "_schema"

# Types that files of the first kind can be read as, without loss.
WIDER = {
    "smallint": ("int", "bigint", "double"), "tinyint": ("smallint", "int", "bigint", "double"),
    "int": ("bigint", "double"), "float": ("double",),
}


class SchemaConflict(ValueError):
    """A column arrives with a type that neither side can be read as."""


def _latest(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in files.names(spark, f"{path}/{FOLDER}") if n.isdigit()), default=0)


def current(spark: SparkSession, path: str) -> T.StructType | None:
    """The stored schema; None for a table without one."""
    latest = _latest(spark, path)
    return T.StructType.fromJson(json.loads(files.read_text(spark, f"{path}/{FOLDER}/{latest:010d}"))) if latest else None


def merged(stored: T.StructType, arriving: T.StructType) -> T.StructType:
    """Stored columns first, each with the wider type of the two; new ones after them."""
    kinds = {f.name: f.dataType for f in arriving.fields}
    out = []
    for field in stored.fields:
        mine, other = field.dataType, kinds.get(field.name, field.dataType)
        if mine != other and mine.simpleString() != other.simpleString():
            if other.simpleString() in WIDER.get(mine.simpleString(), ()):
                mine = other
            elif mine.simpleString() not in WIDER.get(other.simpleString(), ()):
                raise SchemaConflict(f"{field.name} is {mine.simpleString()} in the table and arrives as {other.simpleString()}")
        out.append(T.StructField(field.name, mine))
    known = set(stored.fieldNames())
    return T.StructType(out + [T.StructField(f.name, f.dataType) for f in arriving.fields if f.name not in known])


def evolve(spark: SparkSession, path: str, arriving: T.StructType) -> T.StructType:
    """Make the stored schema hold ``arriving`` as well, and return it.

    If another writer was first, its columns are taken in and the next number is tried.
    """
    while True:
        latest = _latest(spark, path)
        stored = current(spark, path) if latest else None
        wanted = merged(stored or T.StructType([]), arriving)
        if stored is not None and wanted.simpleString() == stored.simpleString():
            return stored
        if files.create(spark, f"{path}/{FOLDER}/{latest + 1:010d}", wanted.json()):
            return wanted
