"""Operator 8: language identification by multilingual mixture inference.

Language models are counts of hashed letter triples (with word edges) and of whole
words.  A document is a mixture of languages: expectation-maximisation estimates each
language's share from the likelihoods of the document's words, and the number of
languages is chosen by penalised likelihood, with a price per language that grows with
the logarithm of the document's length.  The label is the language with the largest share.

Models have languages * BUCKETS numbers, whatever the corpus; counts cover all learning
documents.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so
is every text when nothing could be learned; a null doc_id counts as the text "" in the
fold; ties go to the language first in the alphabet; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import input_columns, tidy

BUCKETS = 1 << 14
WORD_BUCKETS = 1 << 13
UNDETERMINED = "und"
#: Price of one more language in units of log(words) / 2.
PENALTY = 6.0
STEPS = 5
#: Bytes of texts worked on at once; an array over their features takes some ten times that.
BLOCK = 1 << 19


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as no text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def features(words: ta.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of a batch, word by word, and the first feature of each word.

    A word of b bytes has b triples (its edges count as blanks) and itself.
    """
    low = ta.LOWER[words.data]
    size = words.end - words.start
    first = np.cumsum(size + 1) - (size + 1)
    total = int((size + 1).sum())
    out = np.empty(total, np.int32)
    byte = np.ones(total, bool)
    byte[first] = False
    out[first] = BUCKETS + (words.hash % np.uint64(WORD_BUCKETS)).astype(np.int32)
    place = np.repeat(words.start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    middle = low[place].astype(np.uint32)
    left = low[np.maximum(place - 1, 0)].astype(np.uint32)
    right = low[np.minimum(place + 1, len(low) - 1)].astype(np.uint32)
    ends = np.cumsum(size)
    left[ends - size] = 0
    right[ends - 1] = 0
    mixed = (left * np.uint32(0x9E3779B1)) ^ (middle * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    out[byte] = (mixed >> np.uint32(18)).astype(np.int32)
    return out, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in ta.pieces(batch, "text", BLOCK):
            langs = np.array(part.column("lang").to_pylist(), object)
            words = ta.Words(part.column("text"))
            if not len(words.hash):
                continue
            found, first = features(words)
            per_word = np.diff(np.append(first, len(found)))
            for lang in set(langs):
                mine = np.repeat((langs == lang)[words.text], per_word)
                counts.setdefault(lang, np.zeros(BUCKETS + WORD_BUCKETS, np.int64))
                counts[lang] += np.bincount(found[mine], minlength=BUCKETS + WORD_BUCKETS)
    for lang, row in counts.items():
        there = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(row[there])], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (bucket by language), from (text, lang)."""
    labelled = docs.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = (
        labelled.mapInArrow(tidy(_count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # BUCKETS + WORD_BUCKETS at most
        .orderBy("lang").collect()
    )
    table = np.full((BUCKETS + WORD_BUCKETS, len(rows)), 0.5)
    for k, row in enumerate(rows):
        for bucket, n in row["counts"]:
            table[bucket, k] += n
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        table[part] /= table[part].sum(axis=0, keepdims=True)
    return [r["lang"] for r in rows], np.log(table).astype(np.float32)


def shares(likelihood: np.ndarray, first: np.ndarray, count: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares after EM, and the log likelihood, of texts whose words stand together.

    Arrays have one row per language, so that every sum runs along memory.
    """
    weighted = np.repeat(pi, count, axis=1) * likelihood
    total = weighted.sum(axis=0)
    for _ in range(steps):
        weighted /= total
        pi = np.add.reduceat(weighted, first, axis=1) / count.astype(np.float32)
        np.multiply(np.repeat(pi, count, axis=1), likelihood, out=weighted)
        total = weighted.sum(axis=0)
    return pi, np.add.reduceat(np.log(total), first)


def infer(words: ta.Words, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language shares and the number of languages of every text (0 for one without words)."""
    n_texts, n_langs = len(words.count), model.shape[1]
    all_shares, sets = np.zeros((n_texts, n_langs)), np.zeros(n_texts, np.int64)
    full = np.flatnonzero(words.count)
    if not len(full):
        return all_shares, sets
    found, first_feature = features(words)
    log_word = np.stack([np.add.reduceat(column[found], first_feature) for column in model.T])
    log_word -= log_word.max(axis=0)
    # The floor keeps a single odd word from ruling a language out.
    likelihood = np.maximum(np.exp(log_word), np.float32(1e-12))
    first, count = words.first[:-1][full], words.count[full]
    pi, _ = shares(likelihood, first, count, np.full((n_langs, len(full)), 1 / n_langs, np.float32), STEPS)
    order = np.argsort(-pi, axis=0, kind="stable")
    rank = np.argsort(order, axis=0, kind="stable")
    best_score = np.full(len(full), -np.inf)
    chosen, size = np.zeros((n_langs, len(full)), np.float32), np.zeros(len(full), np.int64)
    open_ = np.ones(len(full), bool)
    for k in range(1, n_langs + 1):
        # A set grows only while the last language paid its price.
        docs = np.flatnonzero(open_)
        if not len(docs):
            break
        start = np.where(rank[:, docs] < k, np.maximum(pi[:, docs], np.float32(1e-6)), np.float32(0))
        start /= start.sum(axis=0)
        part = likelihood if len(docs) == len(full) else likelihood[:, np.repeat(open_, count)]
        got, log_likelihood = shares(part, np.cumsum(count[docs]) - count[docs], count[docs], start, STEPS if k > 1 else 0)
        score = log_likelihood - PENALTY * k * np.log(count[docs] + 1) / 2
        better = score > best_score[docs]
        best_score[docs[better]] = score[better]
        chosen[:, docs[better]] = got[:, better]
        size[docs[better]] = k
        open_[docs[~better]] = False
    all_shares[full], sets[full] = chosen.T, size
    return all_shares, sets


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


def _predict(langs: list[str], model: np.ndarray, text: str, kept: int):
    """Batches of the first ``kept`` columns and what was found in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, text, BLOCK):
                pi, size = infer(ta.Words(part.column(text)), model)
                fine = has_letter(part.column(text).to_pylist()) & (size > 0)
                top = pi.argmax(axis=1)
                pred = [langs[t] if ok else UNDETERMINED for t, ok in zip(top, fine, strict=True)]
                score = np.where(fine, np.clip(pi.max(axis=1), 0, 1), 0.0)
                sets = [",".join(langs[i] for i in np.argsort(-p, kind="stable")[:k]) if ok else "" for p, k, ok in zip(pi, size, fine, strict=True)]
                names = part.schema.names[:kept]
                rest = [part.column(i) for i in range(kept)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.string())], [*names, "lang_pred", "score", "lang_set"])

    return run


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, *carry: str) -> DataFrame:
    """``carry`` columns, lang_pred, score and lang_set of every text; only the text is read for them."""
    if not langs:
        empty = F.lit(UNDETERMINED), F.lit(0.0), F.lit("")
        return docs.select(*carry, *[c.alias(n) for c, n in zip(empty, ("lang_pred", "score", "lang_set"), strict=True)])
    # A text that is carried anyway goes to Python once.
    rows, text = (docs.select(*carry), "text") if "text" in carry else (docs.select(*carry, F.col("text").alias("_text")), "_text")
    kinds = [docs.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.StringType())]
    return rows.mapInArrow(tidy(_predict(langs, model, text, len(carry))), T.StructType(kinds))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set; learns from the documents not held out."""
    rows = input_columns(docs, "doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    langs, model = learn(rows.filter(~F.col("held_out")))
    return predict(rows, langs, model, "doc_id", "held_out")
