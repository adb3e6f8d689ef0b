"""Operator 9: personal data by pattern, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities.  Then the corpus tells which terms reveal one.  An entity counts as its value
and as the groups it belongs to (its kind; domain and owner name of an e-mail address),
because most values stand in one text only.  A term t stands within ``WINDOW`` words of
an entity or group e in n(t, e) texts and occurs in n(t) texts at all; it discloses e if
P(e | t) = n(t, e) / n(t) reaches ``MIN_DISCLOSURE``, with a support of at least
``MIN_TEXTS`` different texts, and such a share by chance has a probability of at most
``MAX_CHANCE``, given the share of texts that show e.  None of the thresholds depends on
the size of the table.  Such terms are marked wherever they occur, and sanitising
generalises entities to their kind and removes the terms.

P(e | t) covers all documents; for the support and the share of texts that show e equal
texts count once.  A bitmap of fixed size rules out most words inside the scan, exact
joins decide.

Defined results: null and empty texts have no spans; matches that fail their test are
dropped and not tried again; repeated rows get equal results; an empty table gives an
empty result; other columns are kept by ``sanitise`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import hash_filter, input_columns, maybe_in
from fieldmart.sources.staging import stage

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 3
MIN_TEXTS = 3
#: Least share of a term's texts that show the same entity, and least log2 odds ratio
#: against all texts.
MIN_DISCLOSURE = 0.5
MIN_BITS = 1.0
#: Most probability (Chernoff bound) of the share if the term had nothing to do with the entity.
MAX_CHANCE = 0.01
#: One in so many texts is counted first, to rule out common words.
PARTS = 16
#: Shorter words are never terms.
MIN_TERM_BYTES = 3

# Fixed patterns.  A run of digits or address characters is only tried from its start:
# a match that fails there fails from any later place of the run as well.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_FROM_START = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while text.find("@", at) >= 0:
        m = _EMAIL.match(text, at) if at else None  # right after the last match, inside a run
        m = m or _EMAIL_FROM_START.search(text, at)
        if not m:
            break
        found.append(m.span())
        at = m.end()
    return found


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    if not text:
        return []
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def entity(kind: str, text: str) -> str:
    """One spelling for equal entities."""
    return f"{kind}:{text.lower() if kind == 'email' else re.sub('[^0-9.]' if kind == 'ip' else '[^0-9]', '', text)}"


def levels(kind: str, text: str) -> list[str]:
    """The entity and the groups it belongs to: its kind; domain and owner name of an address."""
    found = [entity(kind, text), f"kind:{kind}"]
    if kind == "email":
        local, _, domain = text.lower().partition("@")
        owner = ".".join(re.findall("[a-z]+", local))
        found += [f"domain:{domain}", *([f"owner:{owner}"] if owner else [])]
    return found


_WORD = regex.compile(ta.LETTER_RUN)
_ANY_DIGIT = re.compile("[0-9]")
_UPPER = {c: chr(c + 32) for c in range(65, 91)}


def _words_before(text: str, start: int) -> list:
    """The last WINDOW words that end before ``start``; a word that reaches into it is none."""
    size = 64
    while True:
        low = max(0, start - size)
        found = list(_WORD.finditer(text, low, start))
        if found and found[-1].end() == start and _WORD.match(text, start, start + 1):
            found.pop()
        # The look-back may have cut its first word.
        if low == 0:
            return found[-WINDOW:]
        if len(found) > WINDOW:
            return found[-WINDOW:]
        size *= 4


def _words_after(text: str, end: int) -> list:
    """The first WINDOW words that begin after ``end``; the rest of a word begun before is none."""
    at = end
    if end and _WORD.match(text, end - 1, end):
        begun = _WORD.match(text, end)
        at = begun.end() if begun else end
    return list(islice(_WORD.finditer(text, at), WINDOW))


def _near(text: str, spans) -> set[tuple[str, str]]:
    """(term, entity or group) for the words around each entity, entities themselves left out."""
    found = set()
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    # The furthest end among the spans up to each one: overlaps are found by bisection.
    reach = list(accumulate((b for _, b in taken), max))

    def clear(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    for kind, start, end in spans:
        names = levels(kind, text[start:end])
        for m in _words_before(text, start) + _words_after(text, end):
            word = m[0].translate(_UPPER)
            if len(word.encode()) >= MIN_TERM_BYTES and not word.isdigit() and clear(*m.span()):
                found.update((word, name) for name in names)
    return found


BASE = T.StructType([
    T.StructField("text_key", T.StringType()),
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]],
    T.StructField("base", T.ArrayType(T.StringType())),
    T.StructField("near_term", T.ArrayType(T.LongType())), T.StructField("near_entity", T.ArrayType(T.StringType())),
    T.StructField("entities", T.ArrayType(T.StringType())),
])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.pieces(batch, "text", 1 << 20):
            rows = []
            for text in part.column("text").to_pylist():
                spans = base_spans(text) if text and _ANY_DIGIT.search(text) or text and "@" in text else []
                near = sorted(_near(text, spans)) if spans else []
                rows.append((spans, near, sorted({e for k, a, b in spans for e in levels(k, text[a:b])})))
            terms = sorted({t for _, near, _ in rows for t, _ in near})
            codes = dict(zip(terms, ta.Words(pa.array(terms, pa.string())).hash.view(np.int64).tolist(), strict=True)) if terms else {}
            columns = [
                part.column("text_key"),
                *[pa.array([sum(s[0] == k for s in spans) for spans, _, _ in rows], pa.int64()) for k in KINDS[:4]],
                pa.array([[f"{k}:{a}:{b}" for k, a, b in spans] for spans, _, _ in rows], pa.list_(pa.string())),
                pa.array([[codes[t] for t, _ in near] for _, near, _ in rows], pa.list_(pa.int64())),
                pa.array([[e for _, e in near] for _, near, _ in rows], pa.list_(pa.string())),
                pa.array([shown for _, _, shown in rows], pa.list_(pa.string())),
            ]
            rest = [n for n in part.schema.names if n not in ("text", "text_key")]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), *columns], [*rest, *BASE.fieldNames()])


def _terms_in(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 21):
                words = ta.Words(ta.letter_runs(part.column("text")))
                at = np.flatnonzero(maybe_in(bitmap, words.hash))
                # Offsets in code points: bytes of the text as given that do not continue a character.
                data, _ = ta.buffer_of(part.column("text"))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(at) else np.zeros(1, np.int64)
                base = points[words.offsets[words.text[at]]] if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("text_key").take(pa.array(words.text[at])), pa.array(words.hash[at].view(np.int64)),
                        pa.array((points[words.start[at]] - base).astype(np.int64)), pa.array((points[words.end[at]] - base).astype(np.int64)),
                    ],
                    ["text_key", "term", "start", "end"],
                )

    return run


def _texts_with(bitmap: np.ndarray):
    """Per piece of a batch: how many of its texts hold each term that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 21):
                words = ta.Words(ta.letter_runs(part.column("text")))
                at = np.flatnonzero(maybe_in(bitmap, words.hash))
                hashes, text = words.hash[at], words.text[at]
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                once = np.ones(len(hashes), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                terms, n = np.unique(hashes[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return run


def _tells(min_disclosure: float, min_bits: float, max_chance: float) -> Column:
    """Whether a term discloses an entity, from n_both, n_term, texts and p, the share of texts that show it."""
    s, p = F.col("n_both") / F.col("n_term"), F.col("p")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    # Chernoff: a share s of n draws has at most probability exp(-n KL(s, p)); n = texts / s.
    rarity = F.when(p < 1, F.col("texts") / s * (part(s, p) + part(1 - s, 1 - p))).otherwise(0.0)
    raised = s * (1 - p) >= 2.0**min_bits * p * (1 - s)
    return (s >= min_disclosure) & (s > p) & raised & (rarity >= -math.log(max_chance))


def find(
    docs: DataFrame, min_texts: int = MIN_TEXTS, min_disclosure: float = MIN_DISCLOSURE, min_bits: float = MIN_BITS, max_chance: float = MAX_CHANCE
) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone, base and terms (lists of spans)."""
    rows = input_columns(docs, "doc_id", "text").withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *BASE.fields])
    base = stage(rows.mapInArrow(_find, schema), "entities")
    met = base.filter(F.size("near_term") > 0)
    near = met.select("text_key", F.explode(F.arrays_zip("near_term", "near_entity")).alias("z"))
    pairs = stage(
        near.groupBy(F.col("z.near_term").alias("term"), F.col("z.near_entity").alias("entity"))
        .agg(F.count("*").alias("n_both"), F.count_distinct("text_key").alias("texts"))
        .filter(F.col("texts") >= min_texts),
        "term-entity",
    )
    entities = base.select("text_key", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count_distinct("text_key").alias("n_entity"))
    n_texts = max(base.select(F.count_distinct("text_key")).first()[0], 1)
    count = lambda part, of, name: part.mapInArrow(_texts_with(hash_filter(of, "term")), "term long, n long").groupBy("term").agg(F.sum("n").alias(name))
    # Terms that stand in too many texts of a part already can't reach the share in all: common words drop out.
    part = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == 0)
    pairs = stage(
        pairs.join(count(part, pairs, "n_part"), "term", "left").filter(F.coalesce("n_part", F.lit(0)) * min_disclosure <= F.col("n_both")).drop("n_part"),
        "likely-pairs",
    )
    counted = count(rows, pairs, "n_term")
    telling = stage(
        pairs.join(counted, "term").join(entities, "entity")
        .withColumn("p", F.col("n_entity") / F.lit(float(n_texts)))
        .filter(_tells(min_disclosure, min_bits, max_chance))
        .select("term").distinct(),
        "telling-terms",
    )
    places = rows.mapInArrow(_terms_in(hash_filter(telling, "term")), "text_key string, term long, start long, end long").join(telling, "term")
    spans = (
        places.select("text_key", "start", "end").distinct().groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"))  # part of the text's own result
        .select(F.col("text_key").alias("k"), F.transform("at", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])).alias("terms"))
    )
    return base.join(spans, F.col("text_key") == F.col("k"), "left").select(
        "doc_id", "text_key", *[f"n_{k}" for k in KINDS[:4]], "base", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")
    )


def replace_spans(text: str, spans: list[str]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    cuts = sorted((int(a), int(b), KINDS.index(k)) for k, a, b in (s.split(":") for s in spans))
    out, at, merged = [], 0, []
    for a, b, kind in cuts:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), min(kind, merged[-1][2]))
        else:
            merged.append((a, b, kind))
    for a, b, kind in merged:
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with entities generalised and telling terms removed; same columns."""
    marks = find(docs, **thresholds).select("text_key", F.concat("base", "terms").alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["text_key"])
    marks = marks.withColumnRenamed("text_key", "_key")
    keyed = docs.join(marks, F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_key"), "left")

    @F.pandas_udf("string")
    def swap(text, spans):
        return text.combine(spans, lambda t, s: replace_spans(t, list(s)) if s is not None and t is not None else t)

    # Python gets only the texts that change; a null goes out for every other one.
    changed = swap(F.when(F.col("_spans").isNotNull(), F.col("text")), "_spans")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(changed)
    out = keyed.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
