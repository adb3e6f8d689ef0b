"""Operator 2: near-duplicate classes by ProbMinHash, banding and verification.

Every five-word shingle of a text, weighted by 1 + ln(its count), sends arrivals of a
Poisson process of that rate to random places of the sketch; each place keeps its
earliest arrival.  A shingle stops as soon as its next arrival comes later than every
place's earliest so far.  Two sketches agree at a place with the probability Jaccard
similarity of the weighted shingles.  BANDS bands of ROWS places each give the bucket
keys.

Inside a bucket nothing is paired with everything.  First each text is held against
two texts of its bucket, the hubs, and the verified links are joined into classes.
Members of one bucket that are still in different classes are then paired where they
share a deviation from their hub that a link between them would need (``beyond_hub``):
what is left out cannot be a link.  A link needs a Jaccard similarity of shingle sets
of at least ``SIMILARITY``, computed exactly.

Defined results: equal texts are one class; a text of fewer than five words is a single
shingle; null and wordless texts are never duplicates; repeated rows are duplicates of
each other; the class id is the least doc_id of the class, and the row kept is the one
with the least doc_id (one of them, if several rows share it); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import input_columns, tidy
from fieldmart.sources.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
PLACES = BANDS * ROWS

_U = np.uint64
_ID_BITS = _U((1 << 24) - 1)
_SLACK = 1e-6  # above any rounding error of the bounds on counts


def weighted(words: ta.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of every text, their text numbers and their weights."""
    hashes, owner = words.shingles(SHINGLE)
    if not len(hashes):
        return hashes, owner, np.zeros(0)
    mark = ta.mix(owner.astype(_U) + _U(0x5851F42D4C957F2D))
    _, first, count = np.unique(hashes ^ mark, return_index=True, return_counts=True)
    return hashes[first], owner[first], 1 + np.log(count)


def sketch(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """ProbMinHash sketches (texts by PLACES): which shingle arrived first at each place.

    A kept arrival is one number: the bits of its time, which order like the times,
    with the last 24 replaced by bits of the shingle.
    """
    never = _U(0xFFFFFFFFFFFFFFFF)
    least = np.full((n_texts, PLACES), never)
    flat = least.reshape(-1)
    time = np.zeros(len(hashes))
    active = np.arange(len(hashes))
    step = 0
    while len(active):
        step += 1
        draw = ta.mix(hashes[active] + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        uniform = ((draw >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52
        time[active] += -np.log(uniform) / weight[active]
        place = (ta.mix(draw ^ _U(0xA0761D6478BD642F)) % _U(PLACES)).astype(np.int64)
        arrival = (time[active].view(_U) & ~_ID_BITS) | (hashes[active] & _ID_BITS)
        np.minimum.at(flat, owner[active] * PLACES + place, arrival)
        latest = least.max(axis=1)
        active = active[(time[active].view(_U) & ~_ID_BITS) <= latest[owner[active]]]
    return least & _ID_BITS


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per text and band."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    key = np.broadcast_to(ta.mix(np.arange(1, BANDS + 1, dtype=_U)), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = ta.mix(key * _U(0x9E3779B97F4A7C15) ^ parts[:, :, r])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.pieces(batch, "text", 1 << 19):
            words = ta.Words(part.column("text"))
            hashes, owner, weight = weighted(words)
            keys = band_keys(sketch(hashes, owner, weight, len(part)))
            n = np.bincount(owner, minlength=len(part))
            has = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(n.astype(np.int64)), bands], ["doc_id", "text_key", "n_shingles", "bands"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.pieces(batch, "a_text", 1 << 18):
            both = pa.concat_arrays([part.column("a_text").cast(pa.string()), part.column("b_text").cast(pa.string())])
            hashes, owner, _ = weighted(ta.Words(both))
            n = len(part)
            size = np.bincount(owner, minlength=2 * n)
            pair = owner % n
            common = ta.mix(pair.astype(_U) + _U(77)) ^ hashes
            _, first, count = np.unique(common, return_index=True, return_counts=True)
            shared = np.bincount(pair[first[count > 1]], minlength=n)
            union = size[:n] + size[n:] - shared
            jaccard = shared / np.maximum(union, 1)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(jaccard)], ["a", "b", "jaccard"])


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of vertices whose texts are similar enough."""
    a = texts.select(F.col("v").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("v").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(tidy(_similar), "a long, b long, jaccard double").filter(F.col("jaccard") >= similarity)


def _tolerance(similarity: float) -> float:
    """Sets x and y are similar if and only if |x ^ y| <= _tolerance * (|x| + |y|)."""
    return (1 - similarity) / (1 + similarity)


def _deviations(similarity: float):
    """Function on batches: all shingles that only one of a text and its hub has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 18):
                both = pa.concat_arrays([part.column("text").cast(pa.string()), part.column("hub_text").cast(pa.string())])
                hashes, owner, _ = weighted(ta.Words(both))
                n = len(part)
                pair = owner % n
                _, first, count = np.unique(ta.mix(pair.astype(_U) + _U(77)) ^ hashes, return_index=True, return_counts=True)
                own, hub = np.split(np.bincount(owner, minlength=2 * n), 2)
                shared = np.bincount(pair[first[count > 1]], minlength=n)
                linked = shared / np.maximum(own + hub - shared, 1) >= similarity
                alone = first[count == 1]
                alone = alone[np.argsort(pair[alone], kind="stable")]
                d = np.bincount(pair[alone], minlength=n)
                ends = np.concatenate([[0], np.cumsum(d)]).astype(np.int32)
                marks = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[alone].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("hub", "v", "label")), pa.array(own), pa.array(hub), pa.array(d), pa.array(linked), marks],
                    ["hub", "v", "label", "n", "n_hub", "d", "linked", "marks"],
                )

    return run


def beyond_hub(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of a hub, of different label, that can be similar.

    ``members`` has hub, v and label; members similar to the same hub share a label.
    Let D(x) be the shingles in which x and its hub h differ.  x ^ y = D(x) ^ D(y), so
    with r = _tolerance a link between x and y needs

        |D(x) & D(y)| >= s = (|D(x)| + |D(y)| - r (|x| + |y|)) / 2.

    One of the two, say y, is not similar to h: |D(y)| > r (|y| + |h|), and as |D(x)| is
    at least the difference of the sizes of x and h, s is above 0.  Sets in a common
    order that share s elements share one among the first |D| - s + 1 of either, hence
    an equality join on single deviations finds every link.  The partner y not being
    similar, s > (|D(x)| + r (|h| - |x|)) / 2: that bounds what x needs of D(x).
    The order is by frequency within the hub, rare ones first; deviations that no pair
    in question shares come before all and are only counted.  Copies with edits of
    their own share few rare ones, however many copies there are, so the rows made
    follow the deviations and not the square of a group.
    """
    r = _tolerance(similarity)
    own = texts.select("v", "text")
    hubs = texts.select(F.col("v").alias("hub"), F.col("text").alias("hub_text"))
    schema = "hub long, v long, label long, n long, n_hub long, d long, linked boolean, marks array<long>"
    found = members.filter("v <> hub").join(own, "v").join(hubs, "hub").select("hub", "v", "label", "text", "hub_text")
    deviating = stage(found.mapInArrow(tidy(_deviations(similarity)), schema), "deviations")
    one = deviating.select("hub", "v", "label", "linked", F.explode("marks").alias("mark"))
    counts = (
        one.groupBy("hub", "mark").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("linked").alias("all_linked"))
        .filter("f > 1 AND low < high AND NOT all_linked").select("hub", "mark", "f")
    )
    mine = Window.partitionBy("hub", "v")
    at = F.col("d") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "mark")) - 1
    # What may be needed with a partner not similar to the hub, and with any partner.
    open_partner = F.col("at") <= (F.col("d") - r * (F.col("n_hub") - F.col("n"))) / 2 + _SLACK
    any_partner = F.col("at") <= (F.col("d") + r * (F.col("n") + F.col("n_hub"))) / 2 + _SLACK
    sizes = deviating.select("hub", "v", "n", "n_hub", "d")
    ranked = stage(
        one.join(counts, ["hub", "mark"]).join(sizes, ["hub", "v"]).withColumn("at", at)
        .filter(F.when(F.col("linked"), open_partner).otherwise(any_partner)),
        "ranked-deviations",
    )
    x, y = (
        side.select("hub", "mark", *[F.col(c).alias(f"{c}_{s}") for c in ("v", "label", "n", "d", "linked", "at")])
        for side, s in ((ranked.filter(open_partner), "x"), (ranked.filter("NOT linked"), "y"))
    )
    s = (F.col("d_x") + F.col("d_y") - r * (F.col("n_x") + F.col("n_y"))) / 2
    within = (F.col("at_x") <= F.col("d_x") - s + _SLACK) & (F.col("at_y") <= F.col("d_y") - s + _SLACK)
    once = F.col("linked_x") | (F.col("v_x") < F.col("v_y"))
    alike = F.least("n_x", "n_y") >= F.lit(similarity) * F.greatest("n_x", "n_y")  # else their Jaccard is lower
    apart = (F.col("label_x") != F.col("label_y")) & once & alike & within
    pairs = x.join(y, ["hub", "mark"]).filter(apart)
    return pairs.select(F.least("v_x", "v_y").alias("a"), F.greatest("v_x", "v_y").alias("b")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """v, label: the least vertex of the connected component of every linked vertex.

    Alternates two steps until nothing changes: every vertex points its larger
    neighbours to the least one near it, then its smaller ones.  Each round is written
    out, so lineage stays short.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(near.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        edges = stage(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("label")).union(edges.select("v", F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, class_id, class_size and keep for every document."""
    rows = input_columns(docs, "doc_id", "text").withColumn("text_key", F.sha2("text", 256))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.StringType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    marked = stage(rows.mapInArrow(tidy(_bands), schema), "sketches")
    # One vertex per different text; the table is written once, so its numbers stay.
    found = marked.filter("n_shingles > 0").groupBy("text_key").agg(F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    vertices = stage(found.withColumn("v", F.monotonically_increasing_id()), "vertices")
    buckets = vertices.select("v", "n", F.explode("bands").alias("bucket"))
    # A text with few edits of its own falls into the large buckets of its family: the
    # size of a vertex's buckets tells how central it is.
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stage(buckets.join(sizes, "bucket"), "shared-buckets")
    central = shared.groupBy("v").agg(F.sum("members").alias("weight"))
    ranked = shared.join(central, "v")
    hubs = ranked.groupBy("bucket").agg(
        F.max(F.struct("weight", F.xxhash64("v").alias("order"), F.col("v").alias("hub"))).alias("h"),
        F.min(F.struct(F.xxhash64("v", "bucket").alias("order"), F.col("v").alias("hub"))).alias("r"),
    ).select("bucket", F.array_distinct(F.array("h.hub", "r.hub")).alias("hubs"))
    crowded = stage(shared.join(hubs, "bucket"), "buckets")
    first = stage(
        crowded.select("v", F.explode("hubs").alias("hub")).filter("v <> hub")
        .select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct(),
        "pairs",
    )
    # Texts are joined by their hash to the vertices that are in some pair at all.
    involved = crowded.select("v").distinct().join(vertices.select("v", "text_key"), "v")
    texts = stage(rows.join(involved, "text_key").select("v", "text").dropDuplicates(["v"]), "texts")
    links = stage(verify(first, texts, similarity), "links-found")
    labels = stage(classes(links), "labels")
    named = crowded.select("bucket", "v", F.col("hubs")[0].alias("hub")).join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    split = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    open_ = named.join(split, "bucket").select("hub", "v", "label").distinct()
    second = beyond_hub(open_, texts, similarity).join(first, ["a", "b"], "left_anti")
    more = stage(verify(second, texts, similarity), "links-more")
    merged = stage(classes(links.union(more).select("a", "b")), "labels")
    label = vertices.select("text_key", "v").join(merged, "v", "left").select("text_key", F.coalesce("label", "v").alias("label"))
    lone = F.col("text_key").isNull() | (F.col("n_shingles") == 0)
    members = stage(
        marked.select("doc_id", "text_key", "n_shingles").join(label, "text_key", "left").withColumn("row", F.monotonically_increasing_id()),
        "members",
    )
    sizes = members.filter("label IS NOT NULL").groupBy("label").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("best")
    )
    return members.join(sizes, "label", "left").select(
        "doc_id", "text_key",
        F.when(lone, F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("keep"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every class, the one with the least doc_id, with all its columns.

    Documents that stand alone stay.  Rows are told apart by doc_id and text; of rows
    equal in both, one stays.
    """
    found = near_duplicates(docs)
    gone = found.filter(~F.col("keep")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.sha2("text", 256) == F.col("_key"))
    kept = found.filter("keep AND class_size > 1").select(F.col("doc_id").alias("_kid"), F.col("text_key").alias("_kkey")).distinct()
    both = gone.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_key") == F.col("_kkey")), "left_semi")
    rest = docs.join(gone, same, "left_anti")
    # A kept row may have equal twins among those that go: bring one of them back.
    again = docs.join(both, same, "left_semi").withColumn("_k", F.sha2("text", 256)).dropDuplicates(["doc_id", "_k"]).drop("_k")
    return rest.unionByName(again)
