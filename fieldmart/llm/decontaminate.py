"""Operator 6: benchmark decontamination by winnowing.

Every window of ``SPAN`` words keeps the smallest hash among its ``WINDOW_GRAMS`` runs of
``GRAM`` words as its fingerprint, so equal windows have equal fingerprints and no shared
span of that length is missed.  Items of fewer than ten words are one window each, with
the hash of all their words; documents are looked through for runs of just those lengths.
Two bitmaps of fixed size, of fingerprints and of whole windows, rule out most windows of
a document inside the scan.  The rest are joined with those of the benchmark on the
fingerprint, and extended: the words of both windows must be the same.  Only windows that
match move on, so a phrase that is common to many items and documents makes no pairs.

Defined results: null and wordless texts have no words and are never hit; an item that
occurs twice counts under each of its ids; repeated documents get equal rows; an empty
benchmark or table leaves nothing hit; texts of any length are worked through in pieces;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import hash_filter, input_columns, maybe_in
from fieldmart.sources.staging import stage

SPAN = 10
GRAM = 5
WINDOW_GRAMS = SPAN - GRAM + 1


def fingerprints(words: ta.Words) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hash of every window of SPAN words inside one text, and its first word."""
    hashes, at = words.grams(GRAM)
    m = len(hashes) - WINDOW_GRAMS + 1
    if m <= 0:
        return hashes[:0], at[:0]
    least = hashes[:m].copy()
    for j in range(1, WINDOW_GRAMS):
        np.minimum(least, hashes[j : m + j], out=least)
    inside = words.text[at[:m]] == words.text[at[WINDOW_GRAMS - 1 :]]
    return least[inside], at[:m][inside]


def window_hashes(words: ta.Words, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at the given words."""
    total = np.zeros(len(first), np.uint64)
    for j in range(n):
        total += ta.mix(words.hash[first + j] + np.uint64(2 * j + 1))
    return ta.mix(total + np.uint64(n))


def short_runs(words: ta.Words, lengths: list[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, hashes and first words of runs below SPAN: of short texts only, or of all."""
    for n in lengths:
        hashes, at = words.grams(n)
        if whole:
            mine = words.count[words.text[at]] == n
            hashes, at = hashes[mine], at[mine]
        yield n, ta.mix(hashes + np.uint64(n)), at


_GAPS = re.compile(b"\0+")


def window_words(words: ta.Words, first: int, n: int) -> str:
    """The words of one window, lower-cased, with single blanks between."""
    low = ta.LOWER[words.data[words.start[first] : words.end[first + n - 1]]].tobytes()
    return _GAPS.sub(b" ", low).decode()


WINDOW = "hash long, window long, n int, words string"


def _rows(words: ta.Words, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
    """(text, first word, hash, window hash, length, words) of windows, as lists; ordered by text."""
    rows = [
        (int(words.text[f]), int(f - words.first[words.text[f]]), h, w, n, window_words(words, f, n))
        for n, hashes, windows, first in found
        for h, w, f in zip(hashes.view(np.int64).tolist(), windows.view(np.int64).tolist(), first.tolist(), strict=True)
    ]
    return sorted(rows)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.pieces(batch, "text", 1 << 20):
            words = ta.Words(part.column("text"))
            hashes, first = fingerprints(words)
            found = [(SPAN, hashes, window_hashes(words, first, SPAN), first)]
            found += [(n, h, window_hashes(words, f, n), f) for n, h, f in short_runs(words, list(range(1, SPAN)), True)]
            rows = _rows(words, found)
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(column(0, pa.int64())), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.int32()), column(5, pa.string())],
                ["item_id", "hash", "window", "n", "words"],
            )


HIT = T.StructType([T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.StringType())])


def _document_windows(prints: np.ndarray, whole: np.ndarray, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text"):
                words = ta.Words(part.column("text"))
                found = []
                for n, hashes, first in [(SPAN, *fingerprints(words)), *short_runs(words, lengths, False)]:
                    stay = maybe_in(prints, hashes)
                    hashes, first = hashes[stay], first[stay]
                    windows = window_hashes(words, first, n)
                    stay = maybe_in(whole, windows)
                    found.append((n, hashes[stay], windows[stay], first[stay]))
                rows = _rows(words, found)
                ends = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(part) + 1)).astype(np.int32)
                hit = pa.StructArray.from_arrays(
                    [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.string())],
                    HIT.fieldNames(),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), hit)],
                    ["doc_id", "text_key", "n_words", "found"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, item_ids for every document.

    ``text_key`` is a hash of the text; texts with equal keys are extended once.
    """
    items = input_columns(benchmark, "item_id", "text")
    kept = stage(
        items.mapInArrow(_item_windows, T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), *T.StructType.fromDDL(WINDOW).fields])).distinct(),
        "item-windows",
    )
    lengths = [r["n"] for r in kept.filter(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()]  # below SPAN
    text = input_columns(docs, "doc_id", "text").withColumn("text_key", F.sha2(F.col("text"), 256))
    found = stage(
        text.mapInArrow(
            _document_windows(hash_filter(kept, "hash"), hash_filter(kept, "window"), lengths),
            T.StructType([
                T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.StringType()), T.StructField("n_words", T.LongType()),
                T.StructField("found", T.ArrayType(HIT)),
            ]),
        ),
        "document-windows",
    )
    same = ["hash", "n", "words"]
    hits = stage(
        found.filter(F.size("found") > 0).select("text_key", F.explode("found").alias("f")).select("text_key", "f.*").distinct()
        .join(kept.select(*same).distinct(), same),
        "window-hits",
    )
    # Windows of one text: part of its own result.
    spans = hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "spans", F.struct(zero.alias("words"), zero.alias("end")),
        lambda a, s: F.struct(
            (a["words"] + F.greatest(zero, s["end"] - F.greatest(s["at"], a["end"]))).alias("words"), F.greatest(a["end"], s["end"]).alias("end")
        ),
    )
    met = (
        hits.select("text_key", *same).distinct().join(kept, same).select("text_key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("text_key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    extended = spans.select(F.col("text_key").alias("h_key"), covered["words"].alias("n_hit")).join(met.withColumnRenamed("text_key", "m_key"), F.col("h_key") == F.col("m_key"))
    return found.join(extended, F.col("text_key") == F.col("h_key"), "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of which no word lies in a benchmark window, with all their columns."""
    bad = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("text_key").alias("_bad")).distinct()
    return docs.join(bad, F.sha2(F.col("text"), 256) == F.col("_bad"), "left_anti")
