"""Operator 7 [native]: quality rules and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and repeated three-word windows.  The
verdict compares two multinomials over hashed words and word pairs: one of trusted
documents, one of the whole corpus.  A document's score is the mean log ratio of its
features, so length does not matter, and every document is held against the same
threshold.  Everything is built from DataFrame functions.

The corpus model covers all documents, the trusted model all documents labelled 1.

Defined results: a null text has no words, lines or symbols and fails the base rules;
repeated rows get equal results; with no trusted row the ratio is 0 everywhere, so the
base rules alone decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmart.llm.frames import FILTER_BITS, input_columns

# White space between words, symbol characters, limits of the base rules.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BUCKETS = 1 << 16
#: Lowest mean log ratio that is kept.
THRESHOLD = -0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; none for null.  One literal blank splits many times faster than a pattern."""
    plain = reduce(lambda c, space: F.replace(c, F.lit(space), F.lit(" ")), SPACES[1:], text)
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _count_of(text: Column, chars: str) -> Column:
    """Number of characters out of ``chars``; most texts have none, which a search finds soonest."""
    return F.when(text.rlike(f"[{chars}]"), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(tokens: Column) -> Column:
    """Words inside a three-word window that the text has twice or more.

    Windows are sorted by hash, so equal ones become neighbours; their places, sorted
    again, add the words that each covers beyond the next one's start.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda s, k: F.coalesce((k > 0) & (F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"] == s["h"]), F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda s: s["i"])), covered)

    def windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, twice))

    def hashes(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return let(F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), windows)

    return let(tokens, hashes)


def features(rows: DataFrame) -> DataFrame:
    """One row per word of the column ``w``: ``one``, the bucket of the word, and ``two``, that of the word and the next.

    The last word of a text has no ``two``.  Rows are unfolded instead of arrays being
    transformed, so hashing and adding up run in generated code.
    """
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    unfolded = rows.select("*", F.posexplode_outer("w").alias("_at", "_word"))
    word, after = F.lower("_word"), F.lower(F.get("w", F.col("_at") + 1))
    return unfolded.select(
        *[c for c in rows.columns if c != "w"],
        F.when(F.col("_word").isNotNull(), bucket(word)).alias("one"), F.when(after.isNotNull(), bucket(word, after)).alias("two"),
    )


def counts(texts: DataFrame, name: str) -> DataFrame:
    """Features of all texts by bucket: BUCKETS rows at most, added up where texts are read."""
    found = features(texts.select(words(F.col("text")).alias("w"))).select(F.explode(F.array("one", "two")).alias("bucket"))
    return found.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def known_ids(ids: DataFrame) -> Column:
    """A bitmap of fixed size over the hashes of ``t_id``, as a scalar array of longs."""
    place = F.shiftrightunsigned(F.xxhash64("t_id"), 64 - FILTER_BITS)
    bits = ids.select((place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    every = ids.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").cast("int").alias("word"))
    table = every.join(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "word", "left")
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda s: s["bits"]).alias("bitmap")).scalar()


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts labelled 1, all of them.

    Only rows that the bitmap lets through are dealt out for the join, which is of one
    kind at every size.
    """
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("t_id")).distinct()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    bit = F.call_function("shiftrightunsigned", F.get(known_ids(ids), (place / 64).cast("int")), (place % 64).cast("int")).bitwiseAND(F.lit(1))
    likely = docs.filter(F.col("doc_id").isNotNull() & (bit == 1))
    return likely.join(ids.hint("merge"), F.col("doc_id") == F.col("t_id")).select("text")


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS log ratios, trusted over raw.

    Every bucket has one pseudo-count in proportion to the raw corpus, so features that
    the trusted rows are too few to show count little.
    """
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(docs, "raw"), "bucket", "left").join(counts(trusted_rows(docs, labels), "trusted"), "bucket", "left")
    table = both.agg(
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("trusted", F.lit(0)).alias("trusted")))).alias("t"),
        F.coalesce(F.sum("raw"), F.lit(0)).cast("double").alias("raw_total"),
        F.coalesce(F.sum("trusted"), F.lit(0)).cast("double").alias("trusted_total"),
    )
    raw = lambda c: (c["raw"] + 1.0) / (F.col("raw_total") + BUCKETS)
    return table.select(
        F.transform("t", lambda c: F.log((c["trusted"] + BUCKETS * raw(c)) / (F.col("trusted_total") + BUCKETS) / raw(c))).alias("ratios")
    )


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document."""
    rows = input_columns(docs, "doc_id", "text")
    ratios = log_ratios(rows, input_columns(labels, "doc_id", "quality")).scalar()
    counted = rows.withColumns({"w": words(F.col("text")), "_row": F.monotonically_increasing_id()}).select(
        "_row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(_count_of(F.col("text"), SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(dup_lines(F.col("text")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        "w",
    )
    # The words of a row are added up where it is read; one row per document is dealt out.
    base = [c for c in counted.columns if c not in ("w", "_row")]
    ratio = lambda c: F.coalesce(F.get(ratios, F.col(c)), F.lit(0.0))
    parts = features(counted).select("_row", *base, (ratio("one") + ratio("two")).alias("_part"))
    summed = parts.groupBy("_row").agg(*[F.first(c).alias(c) for c in base], F.sum("_part").alias("_sum"))
    score = F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = summed.select(*base, score.alias("score")).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
