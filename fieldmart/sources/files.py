"""Folder listings through the Hadoop file-system API Spark itself reads with."""

from __future__ import annotations

import csv
import hashlib
import re
import uuid
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; none when it does not exist."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly under ``path``; none when it does not exist."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isFile())


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    target, fs = _path(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file if there is none; whether this call made it.

    The content is written aside and put in place by a rename that never replaces, so
    a reader sees all of it or no file.
    """
    target, fs = _path(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    # A context refuses to rename onto a file; a plain file system may not.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), jvm.org.apache.hadoop.fs.Options.Rename.values()[0:1])
        return True
    except Py4JJavaError:
        fs.delete(aside, False)
        if fs.exists(target):
            return False
        raise


def first_records(spark: SparkSession, paths: Collection[str], at_once: int = 32) -> dict[str, list[str]]:
    """``first_record`` of many files, some at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(paths, pool.map(lambda p: first_record(spark, p), paths), strict=True))


def literal_path(path: str) -> str:
    """The path with the characters escaped that a reader would take for a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def first_record(spark: SparkSession, path: str) -> list[str]:
    """Fields of the first line of a CSV file; none for an empty file."""
    jvm = spark.sparkContext._jvm
    target, fs = _path(spark, path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(target), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([line.removeprefix("\ufeff")]), []) if line else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove the folder ``path`` and what it holds."""
    target, fs = _path(spark, path)
    fs.delete(target, True)


def fingerprint_names(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the files under a partition's folder, sessions apart too."""
    target, fs = _path(spark, path)
    found, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when an entry directly under ``path`` is added, removed or rewritten."""
    target, fs = _path(spark, path)
    entries = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)]
    return str(hash(tuple(sorted(entries))))
