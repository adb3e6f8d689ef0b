"""Operator 12: quality classifier on random-indexing word vectors.

Every word has a fixed sparse index vector, derived from its hash.  A word's context
vector is the sum of the index vectors of its neighbours over the whole corpus, so words
in like company get like vectors without a model being trained.  A document is pooled
from the vectors of its words: their mean, their spread and the lengths of both.  A
two-layer numpy network scores the pooled vector; its temperature is set on a part of the
sample that the weights did not see, so scores are calibrated probabilities.

Words are runs of characters other than white space, hashed into ``WORDS`` rows of
``WIDTH`` numbers, so vectors have one size whatever the corpus; sums cover all documents.
The network is fitted on at most ``max_train`` labelled documents (a fixed pick by hash).

Defined results: a null or empty text, or one of white space, has a pooled vector of zeros
and is scored like any other; repeated rows get equal scores; several labels of one id
count as the highest; null labels teach nothing; a null id is read as '' for the fold;
without labels of both kinds every score is the share of label 1 (0.5 without any); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import input_columns
from fieldmart.llm.langid import fold
from fieldmart.sources.staging import stage

WORDS = 1 << 14
WIDTH = 64
#: Signs per index vector, and neighbours on each side.
SIGNS = 4
REACH = 2
HIDDEN = 32
MAX_TRAIN = 20_000
#: Lowest score that is predicted as label 1.
THRESHOLD = 0.3
EPOCHS = 60
BATCH = 128
BLOCK = 1 << 21

_U = np.uint64


# White space between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """Words of a batch of texts: hash, text number, and words per text."""

    def __init__(self, texts: pa.Array):
        data, offsets = ta.buffer_of(texts)
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hash = ta.run_hashes(ta.BYTE_VALUES[data], starts, ends) if len(data) else np.zeros(0, _U)
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.count = np.bincount(self.text, minlength=len(offsets) - 1)
        self.row = (self.hash % _U(WORDS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector."""
    rows = np.arange(1, WORDS + 1, dtype=_U)
    drawn = np.stack([ta.mix(rows * _U(0x9E3779B97F4A7C15) + _U(k * 0x632BE59BD9B4E019 & (2**64 - 1))) for k in range(SIGNS)], axis=1)
    return (drawn % _U(WIDTH)).astype(np.int64), np.where(drawn >> _U(63), 1, -1).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors, one row per word row met."""
    place, sign = index_vectors()
    total, seen = np.zeros((WORDS, WIDTH), np.int64), np.zeros(WORDS, np.int64)
    for batch in batches:
        for part in ta.pieces(batch, "text", BLOCK):
            for some in _cut(part.column("text")):
                words = Tokens(some)
                seen += np.bincount(words.row, minlength=WORDS)
                for step in range(1, REACH + 1):
                    near = words.text[step:] == words.text[:-step]
                    a, b = words.row[:-step][near], words.row[step:][near]
                    for one, other in ((a, b), (b, a)):
                        for k in range(SIGNS):
                            at = one * WIDTH + place[other, k]
                            total += (np.bincount(at, sign[other, k], minlength=WORDS * WIDTH)).astype(np.int64).reshape(WORDS, WIDTH)
    met = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met]), pa.array([r.astype("<i8").tobytes() for r in total[met]], pa.binary())], ["row", "n", "sums"])


def _cut(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts themselves, or a very long one in parts, each ending with a word."""
    data, _ = ta.buffer_of(texts)
    if len(data) <= 2 * BLOCK:
        yield texts
        return
    at = 0
    while at < len(data):  # one text only
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not SPACE[data[stop]]:
            later = np.flatnonzero(SPACE[data[stop : stop + BLOCK]])
            stop = stop + int(later[0]) if len(later) else min(stop + BLOCK, len(data))
        yield pa.array([data[at:stop].tobytes()], pa.large_binary())
        at = stop


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of each word row: at most WORDS rows a task, whatever it reads."""
    total: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for row, n, sums in zip(batch.column("row").to_pylist(), batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            values = np.frombuffer(sums, "<i8")
            total[row] = total[row] + values if row in total else values
            seen[row] = seen.get(row, 0) + n
    rows = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([seen[r] for r in rows], pa.int64()), pa.array([total[r].astype("<i8").tobytes() for r in rows], pa.binary())], ["row", "n", "sums"])


CONTEXTS = "row int, n long, sums binary"


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A row of WIDTH numbers of length 1 (0: not met) for each of WORDS hashed words, over all texts."""
    told = docs.select("text").mapInArrow(_contexts, CONTEXTS)
    vectors = np.zeros((WORDS, WIDTH))
    for r in told.repartition("row").mapInArrow(_add, CONTEXTS).collect():  # WORDS rows of a fixed size
        vectors[r["row"]] = np.frombuffer(bytes(r["sums"]), "<i8")
    # Neighbours common to all words tell nothing.
    met = np.abs(vectors).sum(axis=1) > 0
    vectors[met] /= np.linalg.norm(vectors[met], axis=1, keepdims=True)
    if met.any():
        vectors[met] -= vectors[met].mean(axis=0)
        vectors[met] /= np.maximum(np.linalg.norm(vectors[met], axis=1, keepdims=True), 1e-12)
    return vectors.astype(np.float32)


POOLED = 2 * WIDTH + 2


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the lengths of both; zeros without words."""
    out = np.zeros((len(texts), POOLED))
    sums, squares, count = np.zeros((len(texts), WIDTH)), np.zeros((len(texts), WIDTH)), np.zeros(len(texts))
    for some in _cut(texts):
        words = Tokens(some)
        n = words.count.astype(np.int64)
        full = np.flatnonzero(n)
        if len(full):
            first = (np.cumsum(n) - n)[full]
            found = vectors[words.row]
            sums[full] += np.add.reduceat(found, first, axis=0)
            squares[full] += np.add.reduceat(found * found, first, axis=0)
        count += n
    full = count > 0
    mean = sums[full] / count[full, None]
    spread = np.sqrt(np.maximum(squares[full] / count[full, None] - mean**2, 0))
    out[full] = np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), np.linalg.norm(spread, axis=1)])
    return out


class Network:
    """Two layers on standardised input, and a temperature."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], temperature: float):
        self.mean, self.scale, self.weights, self.temperature = mean, scale, weights, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Weights on four fifths of the rows by Adam, the temperature on the rest."""
    rnd = np.random.default_rng(seed)
    apart = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    net = Network(x[~apart].mean(axis=0), np.maximum(x[~apart].std(axis=0), 1e-6), [rnd.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rnd.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)], 1.0)
    z, t = (x[~apart] - net.mean) / net.scale, y[~apart]
    share = t.mean()
    weight = np.where(t > 0, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(t))
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    step = 0
    for _ in range(epochs):
        order = rnd.permutation(len(z))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            w1, b1, w2, b2 = net.weights
            inner = z[mine] @ w1 + b1
            active = np.maximum(inner, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ w2 + b2[0], -30, 30)))
            out = weight[mine] * (p - t[mine]) / len(mine)
            back = np.outer(out, w2) * (inner > 0)
            slopes = [z[mine].T @ back + 1e-4 * w1, back.sum(axis=0), active.T @ out + 1e-4 * w2, np.array([out.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if apart.any():
        logits, truth = net.logits(x[apart]), y[apart]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _pooled(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text", BLOCK):
                x = pool(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), part.column("quality").cast(pa.int32())], ["doc_id", "x", "quality"])

    return run


def _score(vectors: np.ndarray, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.pieces(batch, "text", BLOCK):
                score = net.scores(pool(part.column("text"), vectors))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """doc_id, text and quality of documents labelled outside the held-out fold: ``max_train`` ids at most."""
    taught = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold(F.col("doc_id"), 5) != 0)
        .groupBy(F.col("doc_id").alias("t_id")).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("t_id"), "t_id").limit(max_train)
    )
    # max_train ids at most: a broadcast of fixed size.
    return docs.join(F.broadcast(taught), F.col("doc_id") == F.col("t_id")).select("doc_id", "text", "quality")


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network | float]:
    """Word vectors, and the network, or one score for all where labels show one kind only."""
    vectors = word_vectors(docs)
    pooled = training_rows(docs, labels, max_train).mapInArrow(_pooled(vectors), "doc_id long, x binary, quality int")
    # Copies of an id could be many: the limit holds for rows, too.
    rows = stage(pooled, "quality-train").orderBy(F.xxhash64("doc_id", "x"), "doc_id", "quality").limit(max_train).collect()
    x = np.array([np.frombuffer(bytes(r["x"]), "<f8") for r in rows]).reshape(-1, POOLED)
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not 0 < y.sum() < len(y):
        return vectors, float(y.mean()) if len(y) else 0.5
    return vectors, fit(x, y)


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = input_columns(docs, "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    vectors, net = learn(rows.select("doc_id", "text"), input_columns(labels, "doc_id", "quality"), max_train)
    if isinstance(net, float):
        scored = rows.select("doc_id", "held_out", F.lit(net).alias("score"))
    else:
        schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
        scored = rows.mapInArrow(_score(vectors, net), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
