"""Operator 11: audit of how far the sources of a language diverge in their terms.

The matrix of groups (lang, source) by kept terms is cut by columns into blocks, each a
K-squared tree: a quadtree whose levels are bit strings, where a zero bit stands for a
quadrant without any count.  Two groups are compared by walking the tree for both of
them at once.  Where both have a zero quadrant, every term of it costs the same, so the
quadrant is priced by its width; only leaves that are non-zero for at least one of the
two are visited, and their costs are added.

Work is cut so that no step holds more than a block: counting tasks flush their tables at
``TABLE_TERMS`` entries, a block has about ``BLOCK_CELLS`` cells (one term at least, which
has a cell per group), a walk keeps ``FRONTIER`` nodes, and sums are held for pairs of
tiles of ``TILE`` groups.  All arithmetic is on integers.

Defined results: a null text, lang or source counts as ''; repeated rows are documents of
their own; a language without kept terms has value 0 for every pair and no term rows; a
language with one source has no pair rows; ties in value go to the item first in UTF-8
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmart.llm.frames import input_columns
from fieldmart.sources.staging import stage

# Parts per unit, documents that a kept term needs, ranks reported.
UNIT = 1_000_000_000
MIN_DOCS = 3
MAX_RANK = 200

TABLE_TERMS = 250_000
BLOCK_CELLS = 1 << 16
FRONTIER = 1 << 18
TILE_BITS = 8
TILE = 1 << TILE_BITS
#: Tile pairs whose sums a task holds before it passes them on.
HELD_TILES = 32
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20


# ---- counting ----------------------------------------------------------------------------

def _letters() -> bytes:
    """Letters in lower case and bytes beyond ASCII stay, all others become blanks."""
    return bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


LETTERS = _letters()


def _chunks(text: str) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    data = text.encode("utf-8").translate(LETTERS)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + CHUNK)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


TERM_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tables.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        tables.clear()

    for batch in batches:
        for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
            if not text:
                continue
            n, docs = tables.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _chunks(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held >= TABLE_TERMS:
                yield from flush()
                held = 0
    yield from flush()


# ---- K-squared trees ---------------------------------------------------------------------

class Tree:
    """A K-squared tree over a matrix of ``rows`` by ``cols``.

    ``levels[k]`` has four bits per non-zero node of the level above, ``ranks[k]`` the
    number of one bits before each, which is the child's number among its level's
    non-zero nodes.  Leaves stand in the order of their interleaved coordinates.
    """

    def __init__(self, rows: int, cols: int, bits: np.ndarray):
        self.rows, self.cols = rows, cols
        self.depth = depth_of(rows, cols)
        self.levels, self.ranks, at, width = [], [], 0, 4
        for _ in range(self.depth):
            level = bits[at : at + width]
            ranks = np.cumsum(level, dtype=np.int32)
            self.levels.append(level.astype(bool))
            self.ranks.append(ranks - level)
            at, width = at + width, 4 * int(ranks[-1]) if len(ranks) else 0

    @staticmethod
    def build(rows: int, cols: int, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of all levels, and the order of the cells as leaves."""
        depth = depth_of(rows, cols)
        code = np.zeros(len(row), np.int64)
        for k in range(depth):
            code |= ((row >> k & 1) << 1 | (col >> k & 1)) << (2 * k)
        order = np.argsort(code)
        code, levels, nodes = code[order], [], np.zeros(1 if len(row) else 0, np.int64)
        for k in range(depth - 1, -1, -1):
            children = np.unique(code >> (2 * k))
            level = np.zeros(4 * len(nodes), np.uint8)
            level[4 * np.searchsorted(nodes, children >> 2) + (children & 3)] = 1
            levels.append(level)
            nodes = children
        return np.concatenate(levels) if levels else np.zeros(0, np.uint8), order

    def coordinates(self, levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of every non-zero node ``levels`` below the root (all: of every leaf)."""
        row = col = np.zeros(1 if self.depth == 0 or self.levels[0].any() else 0, np.int64)
        for level in self.levels[: self.depth if levels is None else levels]:
            one = np.flatnonzero(level)
            row, col = row[one >> 2] << 1 | (one >> 1 & 1), col[one >> 2] << 1 | (one & 1)
        return row, col


def depth_of(rows: int, cols: int) -> int:
    return max(rows - 1, cols - 1, 1).bit_length()


def walk(tree: Tree, price: np.ndarray, floor: np.ndarray, tile_a: int, tile_b: int) -> np.ndarray:
    """Costs of all pairs (a in tile_a, b in tile_b), a < b: [0] a against b, [1] b against a.

    ``price`` has p of every leaf, ``floor`` p of a zero for every row.  A frontier node is
    a pair of row ranges and a range of columns; -1 stands for a zero quadrant.
    """
    top = min(TILE_BITS, tree.depth)
    size = 1 << top
    sums = np.zeros((2, size * size), np.int64)
    widths = [np.zeros((size >> k) ** 2, np.int64) for k in range(top + 1)]
    base_a, base_b = tile_a << top, tile_b << top
    columns = (tree.cols + size - 1) >> top
    node = np.full((2, columns), -1, np.int32)
    rows, cols = tree.coordinates(tree.depth - top)
    for k, tile in enumerate((tile_a, tile_b)):
        mine = np.flatnonzero(rows == tile)
        node[k, cols[mine]] = mine

    def zero(level: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        width = np.minimum(tree.cols, (c + 1) << level) - (c << level)
        np.add.at(widths[level], a * (size >> level) + b, width)

    start = (top, np.zeros(columns, np.int32), np.zeros(columns, np.int32), np.arange(columns, dtype=np.int32), node[0], node[1])
    none = (start[4] < 0) & (start[5] < 0)
    zero(top, start[1][none], start[2][none], start[3][none])
    stack = [(top, *(x[~none] for x in start[1:]))]
    bit_a, bit_b, bit_c = (np.arange(8, dtype=np.int32) >> k & 1 for k in (2, 1, 0))
    while stack:
        level, a, b, c, na, nb = stack.pop()
        if len(a) > FRONTIER // 8:
            half = len(a) // 2
            stack += [(level, *(x[:half] for x in (a, b, c, na, nb))), (level, *(x[half:] for x in (a, b, c, na, nb)))]
            continue
        if level == 0 or not len(a):
            continue
        k = tree.depth - level
        child = level - 1
        bits, ranks = tree.levels[k], tree.ranks[k]
        at_a = (4 * na)[:, None] + (2 * bit_a + bit_c)
        at_b = (4 * nb)[:, None] + (2 * bit_b + bit_c)
        if not len(bits):
            continue
        new_a = np.where((at_a >= 0) & bits[np.maximum(at_a, 0)], ranks[np.maximum(at_a, 0)], -1)
        new_b = np.where((at_b >= 0) & bits[np.maximum(at_b, 0)], ranks[np.maximum(at_b, 0)], -1)
        a, b, c = 2 * a[:, None] + bit_a, 2 * b[:, None] + bit_b, 2 * c[:, None] + bit_c
        there = (base_a + (a << child) < tree.rows) & (base_b + (b << child) < tree.rows) & ((c << child) < tree.cols)
        if tile_a == tile_b:
            there &= (a <= b) if child else (a < b)
        none = (new_a < 0) & (new_b < 0)
        gone = there & none
        zero(child, a[gone], b[gone], c[gone])
        there &= ~none
        a, b, c, na, nb = (x[there] for x in (a, b, c, new_a, new_b))
        if child:
            stack.append((child, a, b, c, na, nb))
            continue
        p = np.where(na >= 0, price[np.maximum(na, 0)], floor[base_a + a])
        q = np.where(nb >= 0, price[np.maximum(nb, 0)], floor[base_b + b])
        square = (p - q) ** 2
        pair = a * size + b
        np.add.at(sums[0], pair, square // q)
        np.add.at(sums[1], pair, square // p)
    sums = sums.reshape(2, size, size)
    wide = np.zeros((size, size), np.int64)
    for level, width in enumerate(widths):
        side = size >> level
        wide += np.repeat(np.repeat(width.reshape(side, side), 1 << level, 0), 1 << level, 1)
    p, q = (np.ones(size, np.int64) for _ in range(2))
    for held, base in ((p, base_a), (q, base_b)):
        real = floor[base : base + size]
        held[: len(real)] = real
    square = (p[:, None] - q[None, :]) ** 2
    sums[0] += wide * (square // q[None, :])
    sums[1] += wide * (square // p[:, None])
    return sums


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), digit by digit, so that no product overflows."""
    rest, out = count.astype(np.int64) + 1, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(3):  # UNIT = 1000 ** 3
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


# ---- blocks ------------------------------------------------------------------------------

TREES = "lang string, cols int, bits binary, n binary, lang_n array<long>, row_n array<struct<row:int,n:long>>, terms array<string>"


def _block(lang: str, rows: int, term: pa.Array, new: np.ndarray, row: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch | None:
    """One tree over the kept terms among sorted (term, row) cells; ``new`` marks a term's first."""
    first = np.flatnonzero(new)
    kept = np.add.reduceat(docs, first) >= MIN_DOCS
    cells = np.repeat(kept, np.diff(np.append(first, len(new))))
    if not kept.any():
        return None
    col = (np.cumsum(kept) - 1)[np.cumsum(new) - 1][cells]
    row, n = row[cells].astype(np.int64), n[cells]
    bits, order = Tree.build(rows, int(kept.sum()), row, col)
    by_row = np.unique(row)
    row_n = np.zeros(len(by_row), np.int64)
    np.add.at(row_n, np.searchsorted(by_row, row), n)
    lang_n = np.zeros(int(kept.sum()), np.int64)
    np.add.at(lang_n, col, n)
    sums = pa.array([[{"row": int(r), "n": int(x)} for r, x in zip(by_row, row_n, strict=True)]], pa.list_(pa.struct([("row", pa.int32()), ("n", pa.int64())])))
    columns = [
        pa.array([lang]), pa.array([int(kept.sum())], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()),
        pa.array([n[order].astype("<i8").tobytes()], pa.binary()), pa.array([lang_n.tolist()], pa.list_(pa.int64())), sums,
        pa.array([term.take(pa.array(first[kept])).to_pylist()], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "cols", "bits", "n", "lang_n", "row_n", "terms"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the cells of a partition sorted by (lang, term); a term is never cut."""
    held: list[pa.RecordBatch] = []
    n_held = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n_held
        rows = pa.Table.from_batches(held).combine_chunks()
        lang, term = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
        fresh_lang, new = np.ones(len(rows), bool), np.ones(len(rows), bool)
        if len(rows) > 1:
            fresh_lang[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = fresh_lang[1:] | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(new)
        end = len(rows) if last else int(edges[-1])  # the last term may go on
        at = 0
        while at < end:
            langs = np.flatnonzero(fresh_lang[at + 1 : end])
            stop = at + 1 + int(langs[0]) if len(langs) else end
            later = edges[np.searchsorted(edges, at + BLOCK_CELLS) :]
            stop = min(stop, int(later[0])) if len(later) else stop
            part = [rows.column(c).to_numpy()[at:stop] for c in ("row", "n", "docs")]
            block = _block(lang[at].as_py(), rows.column("n_rows")[at].as_py(), term.slice(at, stop - at), new[at:stop], *part)
            if block is not None:
                yield block
            at = stop
        rest = rows.slice(end)
        held, n_held = rest.to_batches(), len(rest)

    for batch in batches:
        if len(batch):
            held.append(batch)
            n_held += len(batch)
            if n_held >= 2 * BLOCK_CELLS:
                yield from cut(False)
    if n_held:
        yield from cut(True)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Tree, np.ndarray, np.ndarray, int, dict]]:
    """Per block: language, tree, counts of leaves, totals of rows, number of the language's terms, all columns."""
    for batch in batches:
        for k in range(len(batch)):
            one = {name: batch.column(name)[k] for name in batch.schema.names}
            totals = np.array(one["totals"].as_py(), np.int64)
            bits = np.unpackbits(np.frombuffer(one["bits"].as_py(), np.uint8))
            tree = Tree(len(totals), one["cols"].as_py(), bits)
            yield one["lang"].as_py(), tree, np.frombuffer(one["n"].as_py(), "<i8"), totals, one["lang_terms"].as_py(), one


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int, int], np.ndarray] = {}
    size_of: dict[str, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), got in sums.items():
            top = got.shape[1]
            rows = size_of[lang]
            i, j = np.meshgrid(np.arange(top) + a * top, np.arange(top) + b * top, indexing="ij")
            real = (i < j) & (j < rows)
            one, two, ab, ba = i[real], j[real], got[0][real], got[1][real]
            columns = [pa.repeat(lang, 2 * len(one)), pa.array(np.concatenate([one, two]), pa.int32()), pa.array(np.concatenate([two, one]), pa.int32()), pa.array(np.concatenate([ab, ba]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "row", "other", "value"])
        sums.clear()

    for lang, tree, n, totals, terms, _ in _trees(batches):
        size_of[lang] = len(totals)
        row, _ = tree.coordinates()
        price = share(n, totals[row] + terms)
        floor = share(np.zeros(len(totals), np.int64), totals + terms)
        top = min(TILE_BITS, tree.depth)
        tiles = (len(totals) + (1 << top) - 1) >> top
        for a in range(tiles):
            for b in range(a, tiles):
                got = walk(tree, price, floor, a, b)
                key = (lang, a, b)
                if key in sums and sums[key].shape != got.shape:  # blocks of another depth have smaller tiles
                    yield from flush()
                sums[key] = sums[key] + got if key in sums else got
                if len(sums) > HELD_TILES:
                    yield from flush()
    yield from flush()


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and block the terms above the language's share; as many as can be ranked."""
    for lang, tree, n, totals, terms, one in _trees(batches):
        row, col = tree.coordinates()
        p = share(n, totals[row] + terms)
        q = share(np.array(one["lang_n"].as_py(), np.int64), np.int64(totals.sum() + terms))[col]
        more = np.flatnonzero(p > q)
        value = (p[more] - q[more]) ** 2 // q[more]
        row, col = row[more], col[more]
        order = np.lexsort((col, -value, row))  # columns are in UTF-8 order of their terms
        row, col, value = row[order], col[order], value[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < MAX_RANK
        item = one["terms"].values.take(pa.array(col[best]))
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, int(best.sum())), pa.array(row[best], pa.int32()), item, pa.array(value[best])], ["lang", "row", "item", "value"])


# ---- the audit ---------------------------------------------------------------------------

def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources and the terms that mark a source."""
    rows = input_columns(docs, "text", "lang", "source")
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    size = F.count("*").over(Window.partitionBy("lang"))
    # One row per group: as many as there are pairs of language and source.
    groups = stage(rows.select(*named).distinct().withColumns({"row": number.cast("int"), "n_rows": size.cast("int")}), "audit-groups")
    counts = rows.mapInArrow(_count, TERM_COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = counts.join(groups, ["lang", "source"]).select("lang", "term", "row", "n_rows", "n", "docs")
    blocks = cells.repartition("lang", "term").sortWithinPartitions("lang", "term", "row").mapInArrow(_blocks, TREES)
    trees = stage(blocks, "audit-trees")

    totals = trees.select("lang", F.explode("row_n").alias("r")).groupBy("lang", F.col("r.row").alias("row")).agg(F.sum("r.n").alias("n"))
    lang_terms = trees.groupBy("lang").agg(F.sum("cols").cast("long").alias("lang_terms"))
    known = groups.join(totals, ["lang", "row"], "left")
    profile = known.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce("n", F.lit(0)).alias("n")))), lambda s: s["n"]).alias("totals")
    ).join(lang_terms, "lang")
    ready = trees.join(profile, "lang")
    value = (
        ready.select("lang", "cols", "bits", "n", "totals", "lang_terms").mapInArrow(_pairs, "lang string, row int, other int, value long")
        .groupBy("lang", "row", "other").agg(F.sum("value").alias("value"))
    )
    mine = groups.select("lang", "source", "row")
    others = groups.select("lang", F.col("source").alias("item"), F.col("row").alias("other"))
    # Every pair is a row of the result, with or without terms.
    pairs = (
        mine.join(others, "lang").filter(F.col("row") != F.col("other")).join(value, ["lang", "row", "other"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    marks = (
        ready.select("lang", "cols", "bits", "n", "lang_n", "terms", "totals", "lang_terms").mapInArrow(_telling, "lang string, row int, item string, value long")
        .join(mine, ["lang", "row"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    return pairs.select("*", ranked).unionByName(marks.select("*", ranked).filter(F.col("rank") <= MAX_RANK))
