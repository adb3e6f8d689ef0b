"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and
returns the columns of documents; the last one returns packed pieces.

1. ``language``: drops texts without a letter (language ``und``) and sets ``lang`` to
   the language found.  Models are learned from the stage's own input.
2. ``near_duplicates``: keeps one document of each class of near copies.
3. ``decontaminate``: drops documents that hold a window of a benchmark item.
4. ``personal_data``: replaces personal data and telling terms in the texts.
5. ``packing``: packs what is left into sequences of at most 2048 ids.

Null texts go in the first stage.  An empty table passes every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.llm import decontaminate, langid, neardup, packing, pii
from fieldmart.llm.frames import ship
from fieldmart.llm.queries import vocabulary
from fieldmart.sources.staging import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents in some language, named by the inferred one."""
    ship(spark)
    learning = docs.filter(langid.fold(F.col("doc_id"), 4) != 2)
    langs, model = langid.learn(learning)
    found = langid.predict(docs, langs, model, *docs.columns)
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class."""
    ship(spark)
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a benchmark window."""
    return decontaminate.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents with personal data generalised."""
    ship(spark)
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: packed pieces."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL cannot express language models, sketches or tokenizers; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
