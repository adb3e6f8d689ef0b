"""Operator 13: vector code compression with metric trees over the parts of vectors.

Vectors become integers and are cut into four parts; each part has a codebook that is
refined by rounds of assignment and means.  A task builds, per block of vectors and part,
an anchors hierarchy once: anchors are picked furthest-first, take the points that are
nearer to them, and are merged middle-out into balls upwards and split by the same steps
downwards.  Every ball caches the sum and the number of its points.  A round walks down
from the root with the list of entries that may be nearest to some point of the ball; the
list is inherited and shrinks by the triangle inequality, and a ball with one entry left
gives its cached sums to it without a look at its points.  The last round hands out codes.

Balls only rule entries out, with a margin above rounding; what is left in a leaf is
compared in whole numbers, so results equal those of plain search.  Blocks are a table in
the shared folder, codebooks have a fixed size, and a round shuffles sums per entry only.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped; null ids come last, and rows of one id are ordered by their vectors; shorter
vectors count as filled up with zeros to the longest, and that one to a multiple of four;
fewer than 256 rows make a smaller codebook; equal rows get equal codes; an empty table
gives an empty result; other columns are ignored.  Components of ``MAX_COMPONENT`` or
more, whose squares have no room in a long, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm.frames import input_columns
from fieldmart.sources.staging import stage

# Scale of components, parts of a vector, entries of a codebook, rounds.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

#: Vectors under one root.
BLOCK_ROWS = 4096
#: Points of a ball that is not split any more.
LEAF_POINTS = 24
MAX_COMPONENT = float(1 << 18)
#: A ball rules an entry out only by more than this share of the distances.
MARGIN = 1e-9


# ---- metric trees ------------------------------------------------------------------------

@dataclass
class Balls:
    """Balls of one part.  Ball i holds points[first[i] : last[i]] of ``order``; a leaf has no child."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    total: np.ndarray


def anchors_of(x: np.ndarray, wanted: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Furthest-first anchors, the points each owns (furthest first) and their distances."""
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    order = np.argsort(-away, kind="stable")
    pivots, owned, distance = [0], [order], [away[order]]
    while len(pivots) < wanted:
        widest = int(np.argmax([d[0] for d in distance]))
        if distance[widest][0] <= 0:
            break
        pivot = int(owned[widest][0])
        gained, gaps = [], []
        for k, other in enumerate(pivots):
            apart = float(np.sqrt(((x[pivot] - x[other]) ** 2).sum()))
            # A point nearer to its anchor than half way cannot be nearer to the new one.
            near = len(distance[k]) - int(np.searchsorted(distance[k][::-1], apart / 2, "left"))
            if not near:
                continue
            head = owned[k][:near]
            new = np.sqrt(((x[head] - x[pivot]) ** 2).sum(axis=1))
            moves = new < distance[k][:near]
            if moves.any():
                gained.append(head[moves])
                gaps.append(new[moves])
                owned[k] = np.concatenate([head[~moves], owned[k][near:]])
                distance[k] = np.concatenate([distance[k][:near][~moves], distance[k][near:]])
        mine, gap = np.concatenate(gained), np.concatenate(gaps)
        order = np.argsort(-gap, kind="stable")
        pivots.append(pivot)
        owned.append(mine[order])
        distance.append(gap[order])
    return pivots, owned, distance


def grow(x: np.ndarray) -> Balls:
    """The anchors hierarchy over integer points."""
    x = x.astype(np.float64)
    order: list[np.ndarray] = []
    nodes: list[tuple] = []  # center, radius, first, last, left, right, total
    placed = 0

    def subtree(points: np.ndarray) -> int:
        nonlocal placed
        mine = x[points]
        lowest, highest = mine.min(axis=0), mine.max(axis=0)
        if len(points) <= LEAF_POINTS or (lowest == highest).all():
            center = mine.mean(axis=0)
            radius = float(np.sqrt(((mine - center) ** 2).sum(axis=1)).max())
            order.append(points)
            nodes.append((center, radius, placed, placed + len(points), -1, -1, mine.sum(axis=0)))
            placed += len(points)
            return len(nodes) - 1
        _, owned, _ = anchors_of(mine, max(2, round(len(points) ** 0.5)))
        return merge([points[o] for o in owned if len(o)])

    def merge(groups: list[np.ndarray]) -> int:
        """Join the two groups whose common ball is smallest until one is left, then place them in that order."""
        center = np.stack([x[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, center, strict=True)])
        weight = np.array([len(g) for g in groups], float)
        plans: list = list(range(len(groups)))
        size = np.sqrt(((center[:, None] - center[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
        np.fill_diagonal(size, np.inf)
        for _ in range(len(groups) - 1):
            a, b = np.unravel_index(int(np.argmin(size)), size.shape)
            middle = (weight[a] * center[a] + weight[b] * center[b]) / (weight[a] + weight[b])
            reach = [float(np.sqrt(((middle - center[k]) ** 2).sum())) + radius[k] for k in (a, b)]
            center[a], radius[a], weight[a] = middle, max(reach), weight[a] + weight[b]
            plans[a] = (plans[a], plans[b])
            size[b] = size[:, b] = np.inf
            rest = np.isfinite(size[a]) & (np.arange(len(size)) != a)
            size[a, rest] = size[rest, a] = np.sqrt(((center[rest] - middle) ** 2).sum(axis=1)) + radius[rest] + radius[a]
        return build(plans[int(a)] if len(groups) > 1 else 0, groups)

    def build(plan, groups: list[np.ndarray]) -> int:
        if not isinstance(plan, tuple):
            return subtree(groups[plan])
        left, right = build(plan[0], groups), build(plan[1], groups)
        one, two = nodes[left], nodes[right]
        n_one, n_two = one[3] - one[2], two[3] - two[2]
        total = one[6] + two[6]
        middle = total / (n_one + n_two)
        radius = max(float(np.sqrt(((middle - o[0]) ** 2).sum())) + o[1] for o in (one, two))
        nodes.append((middle, radius, one[2], two[3], left, right, total))
        return len(nodes) - 1

    subtree(np.arange(len(x)))
    columns = list(zip(*nodes, strict=True))
    return Balls(
        np.concatenate(order), np.stack(columns[0]), np.array(columns[1]), *(np.array(c, np.int64) for c in columns[2:6]),
        np.rint(np.stack(columns[6])).astype(np.int64),
    )


def assign(balls: Balls, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of every point, and sums and numbers of points per entry; ties to the lower entry."""
    owner = np.zeros(len(x), np.int64)
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    points = x[balls.order]
    places = book.astype(np.float64)
    stack = [(len(balls.radius) - 1, np.arange(len(book)))]
    while stack:
        ball, entries = stack.pop()
        gap = np.sqrt(((places[entries] - balls.center[ball]) ** 2).sum(axis=1))
        least = gap.min()
        entries = entries[gap - least <= 2 * balls.radius[ball] + MARGIN * (gap + balls.radius[ball] + 1)]
        first, last = balls.first[ball], balls.last[ball]
        if len(entries) == 1:
            owner[first:last] = entries[0]
            sums[entries[0]] += balls.total[ball]
            counts[entries[0]] += last - first
        elif balls.left[ball] >= 0:
            stack += [(int(balls.left[ball]), entries), (int(balls.right[ball]), entries)]
        else:
            mine = points[first:last]
            same = bool((mine == mine[0]).all())  # any number of equal points is one comparison
            some = mine[:1] if same else mine
            best = entries[((some[:, None] - book[entries][None]) ** 2).sum(axis=2).argmin(axis=1)]
            owner[first:last] = best
            np.add.at(sums, best, balls.total[ball][None] if same else mine)
            np.add.at(counts, best, last - first if same else 1)
    out = np.empty(len(x), np.int64)
    out[balls.order] = owner
    return out, sums, counts


# ---- blocks ------------------------------------------------------------------------------

_ARRAYS = ("order", "center", "radius", "first", "last", "left", "right", "total")
_KINDS = dict(zip(_ARRAYS, ("<i8", "<f8", "<f8", "<i8", "<i8", "<i8", "<i8", "<i8"), strict=True))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled up with zeros to ``width``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _grow(width: int):
    """One row per block: its ids, labels, points and the balls of each part."""

    def block(ids, labels, x: np.ndarray) -> pa.RecordBatch:
        trees = []
        for part in np.split(x, PARTS, axis=1):
            balls = grow(part)
            trees.append({name: getattr(balls, name).astype(_KINDS[name]).tobytes() for name in _ARRAYS})
        columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(labels.type)), pa.array([x.astype("<i8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.struct([(n, pa.binary()) for n in _ARRAYS])))], ["ids", "labels", "points", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK_ROWS - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == BLOCK_ROWS:
                    yield whole(held)
                    held, n = [], 0
        if n:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, labels, x = (rows.column(c).combine_chunks() for c in ("vec_id", "label", "x"))
        return block(ids, labels, _vectors(x, width))

    return run


def _load(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, list[Balls]]:
    points = np.frombuffer(batch.column("points")[k].as_py(), "<i8").reshape(len(batch.column("ids")[k]), width)
    trees = []
    for tree in batch.column("parts")[k].as_py():
        arrays = [np.frombuffer(tree[name], _KINDS[name]) for name in _ARRAYS]
        balls = Balls(*arrays)
        balls.center = balls.center.reshape(len(balls.radius), width // PARTS)
        balls.total = balls.total.reshape(len(balls.radius), width // PARTS)
        trees.append(balls)
    return points, trees


def _sums(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for k in range(len(batch)):
                points, trees = _load(batch, k, width)
                for part, (balls, x) in enumerate(zip(trees, np.split(points, PARTS, axis=1), strict=True)):
                    _, s, n = assign(balls, x, books[part])
                    sums[part] += s
                    counts[part] += n
        for part in range(PARTS):
            used = np.flatnonzero(counts[part])
            entry, place = np.repeat(used, width // PARTS), np.tile(np.arange(width // PARTS), len(used))
            columns = [pa.array(np.full(len(entry), part, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[part][used].ravel()), pa.array(np.repeat(counts[part][used], width // PARTS))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                points, trees = _load(batch, k, width)
                code, error = [], np.zeros(len(points), np.int64)
                for balls, x, book in zip(trees, np.split(points, PARTS, axis=1), books, strict=True):
                    entry, _, _ = assign(balls, x, book)
                    code.append(entry)
                    error += ((x - book[entry]) ** 2).sum(axis=1)
                codes = ["".join(f"{e:02x}" for e in row) for row in np.stack(code, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = input_columns(vectors, "vec_id", "embedding", "label")
    value = F.col("embedding")
    fine = value.isNotNull() & F.forall(value, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    # Components without room in a long fail the run instead of giving wrong distances.
    whole = F.transform(value, lambda e: F.when(F.abs(e) < MAX_COMPONENT, F.floor(e.cast("double") * SCALE)).otherwise(F.raise_error("op13: component out of range").cast("long")))
    kept = rows.filter(fine).select("vec_id", "label", whole.alias("x"))
    longest = kept.agg(F.max(F.size("x")).alias("n")).first()["n"]
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if longest is None:
        return spark.createDataFrame([], result)
    width = -(-longest // PARTS) * PARTS
    # ENTRIES rows at most.
    start = np.zeros((0, width), np.int64)
    for row in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect():
        start = np.vstack([start, np.pad(np.array(row["x"], np.int64), (0, width - len(row["x"])))])
    books = [np.ascontiguousarray(b) for b in np.split(start, PARTS, axis=1)]

    label = T.StructField("label", rows.schema["label"].dataType)
    arrays = T.ArrayType(T.StructType([T.StructField(n, T.BinaryType()) for n in _ARRAYS]))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label.dataType)), T.StructField("points", T.BinaryType()), T.StructField("parts", arrays)])
    blocks = stage(kept.mapInArrow(_grow(width), schema), "code-blocks")
    for _ in range(rounds):
        told = blocks.mapInArrow(_sums(books, width), "part int, entry int, place int, total long, n long")
        # PARTS * ENTRIES entries, one row per component.
        for r in told.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    text = ",".join(str(c) for book in books for entry in book.tolist() for c in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = stage(blocks.mapInArrow(_codes(books, width), schema), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
