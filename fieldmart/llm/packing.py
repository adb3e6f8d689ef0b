"""Operator 1: best-fit packing of token sequences after Martello-Toth reduction.

Only the *number* of pieces of each length matters for the packing, and there are at
most ``capacity`` lengths.  Spark counts them; the counts (a table whose size is
bounded by ``capacity``, however large the corpus) are packed as runs of equal bins;
and Spark deals the pieces to the runs by their number within their length.

Reduction: for a length x, let p be the longest length that still fits beside it.
If nothing fits, {x} is fixed.  If x + p fills the bin, or no two pieces fit beside x,
the bin {x, p} dominates every other bin that holds x, so it is fixed for as many
pairs as there are.  If exactly two pieces at most fit beside x and the best such pair
is no longer than p, {x, p} dominates as well.  What remains is packed by best fit,
longest first.

Defined results: a null or empty text is one piece holding the end mark alone; equal
rows are packed once each; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import input_columns, numbered, tidy
from fieldmart.sources.staging import stage

CAPACITY = 2048
END_ID = 0
#: Words a task keeps with their ids; beyond that, and at its end, it starts anew.
CACHE_WORDS = 600_000
#: Code points below this are read by table; texts with others go to the tokenizer whole.
TABLE_SIZE = 0x250

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])
PLACES = "length long, first long, n long, sequence_first long, offset long"


# ---- counting: lengths -> runs of bins ------------------------------------------------

def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """Fix dominating bins; returns (length, partner or 0, bins) and shrinks ``counts``."""
    fixed = []
    again = True
    while again:
        again = False
        for x in sorted(counts, reverse=True):
            while counts.get(x):
                step = _dominating(counts, x, capacity)
                if step is None:
                    break
                partner, n = step
                fixed.append((x, partner, n))
                _take(counts, x, n)
                if partner:
                    _take(counts, partner, n)
                again = True
    return fixed


def _take(counts: dict[int, int], x: int, n: int) -> None:
    counts[x] -= n
    if not counts[x]:
        del counts[x]


def _dominating(counts: dict[int, int], x: int, capacity: int) -> tuple[int, int] | None:
    room = capacity - x
    lengths = sorted(counts)
    left = lambda y: counts[y] - (y == x)
    i = bisect_right(lengths, room) - 1
    while i >= 0 and not left(lengths[i]):
        i -= 1
    if i < 0:
        # Nothing fits beside x; more of x only if x itself fits twice, which it does not.
        return 0, counts[x] if x not in lengths[: bisect_right(lengths, room)] else 1
    p = lengths[i]
    bins = counts[x] // 2 if p == x else min(counts[x], counts[p])
    if x + p == capacity:
        return p, bins
    small = []
    for y in lengths:
        small += [y] * min(left(y), 3 - len(small))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return p, bins
    if len(small) < 3 or sum(small) > room:
        # Taking pieces never raises the best pair nor lets a third piece in, so what
        # holds for one bin holds for all.
        if p >= _best_pair(lengths, left, room):
            return p, bins
    return None


def _best_pair(lengths: list[int], left, room: int) -> int:
    """The longest total of two pieces that fit into ``room``."""
    best, low, high = 0, 0, bisect_right(lengths, room) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room or not left(b):
            high -= 1
        elif not left(a) or (low == high and left(a) < 2):
            low += 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, n, first sequence, offset) rows that place every piece.

    Pieces first .. first + n - 1 of that length go to n sequences in a row, each at
    ``offset``.  There are a few rows per length, whatever the counts are.
    """
    counts = {x: n for x, n in counts.items() if n}
    used: dict[int, int] = {}
    rows = []
    bins = 0

    def place(x: int, n: int, sequence: int, offset: int) -> None:
        rows.append((x, used.get(x, 0), n, sequence, offset))
        used[x] = used.get(x, 0) + n

    for x, partner, n in reduce_dominated(counts, capacity):
        place(x, n, bins, 0)
        if partner:
            place(partner, n, bins, x)
        bins += n
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, n)
    rooms: list[int] = []  # sorted
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            i = bisect_right(rooms, x - 1)
            if i == len(rooms):
                each = capacity // x
                n, extra = divmod(left, each)
                for number, filled in ((n, each), (1 if extra else 0, extra)):
                    if number:
                        for k in range(filled):
                            place(x, number, bins, k * x)
                        _open(room, rooms, capacity - filled * x, (bins, number))
                        bins += number
                left = 0
                break
            r = rooms[i]
            first, n = room[r].pop()
            if not room[r]:
                del room[r]
                rooms.pop(i)
            take = min(n, left)
            place(x, take, first, capacity - r)
            _open(room, rooms, r - x, (first, take))
            if take < n:
                _open(room, rooms, r, (first + take, n - take))
            left -= take
    return rows


def _open(room: dict, rooms: list[int], r: int, run: tuple[int, int]) -> None:
    if r:
        if r not in room:
            room[r] = []
            rooms.insert(bisect_right(rooms, r), r)
        room[r].append(run)


# ---- tokens ---------------------------------------------------------------------------

class Tokens:
    """Ids of whole texts.  Each different word is encoded once and then looked up."""

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = np.zeros(TABLE_SIZE, np.uint8)  # 0 space, 1 letter, 2 number, 3 other
        low = np.arange(TABLE_SIZE, dtype=np.uint32)
        for c in range(TABLE_SIZE):
            ch = chr(c)
            kind[c] = 1 if regex.match(r"\p{L}", ch) else 2 if regex.match(r"\p{N}", ch) else 0 if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else 3
            low[c] = ord(ch.lower()) if len(ch.lower()) == 1 else c
        self.kind, self.low = kind, low
        vocabulary_ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(max(vocabulary_ids.values()) + 1, bool)
        self.word_end[[i for w, i in vocabulary_ids.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.from_ = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives them without special tokens added."""
        out: list[np.ndarray | None] = [None] * len(texts)
        fast = []
        for i, text in enumerate(texts):
            if text.isascii() or (np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < TABLE_SIZE and "İ" not in text):
                if "<|" not in text or self.plain(text):
                    fast.append(i)
                    continue
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if fast:
            for i, ids in zip(fast, self._by_word([texts[i] for i in fast]), strict=True):
                out[i] = ids
        return out

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        joined = " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        low = self.low[points]
        start = np.empty(len(points), bool)
        start[0] = kind[0] != 0
        start[1:] = (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        self._contractions(points, low, kind, start)
        starts = np.flatnonzero(start)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        gap = np.flatnonzero(kind == 0)
        ends = np.minimum(np.append(starts[1:], len(points)), gap[np.searchsorted(gap, starts)])
        values = ta.mix(low.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        words, first, inverse = np.unique(ta.run_hashes(values, starts, ends), return_index=True, return_inverse=True)
        where = self._look_up(words, first, starts, ends, joined)
        number, many = self.from_[where], self.many[where]
        per_word = many[inverse]
        total = np.concatenate([[0], np.cumsum(per_word)])
        ids = self.pool[np.repeat(number[inverse] - total[:-1], per_word) + np.arange(total[-1])]
        cut = total[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @staticmethod
    def _contractions(points, low, kind, start) -> None:
        """An apostrophe that opens a run and s, t, m, d, re, ve or ll after it are one word.

        The tokenizer splits before it changes case only in name: its normaliser has
        lower-cased the text by then, so the lower-cased letters count.
        """
        at = np.flatnonzero((points == 39) & start)
        at = at[at + 1 < len(points)]
        one = low[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = low[np.minimum(at + 2, len(points) - 1)]
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for places, n in ((at[short], 2), (at[long], 3)):
            start[places + 1] = False
            after = places + n
            after = after[after < len(points)]
            start[after] = kind[after] != 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has.

        Words between spaces are encoded together, which is several times faster than
        one by one; the last id of a word is one that the vocabulary marks as a word end.
        """
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        many = np.diff(np.flatnonzero(self.word_end[ids]), prepend=-1)
        if len(many) != len(words):
            raise ValueError("the vocabulary does not mark word ends")
        return ids, many

    def _look_up(self, words, first, starts, ends, joined) -> np.ndarray:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.known, words)
        missing = np.ones(len(words), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != words[inside]
        new = np.flatnonzero(missing)
        if len(new):
            strings = [joined[starts[k] : ends[k]].lower() for k in first[new].tolist()]
            ids, many = self._encode_words(strings)
            self.pool, old = np.concatenate([self.pool, ids]), len(self.pool)
            # Both are in order, so new words are merged in at their places.
            self.known = np.insert(self.known, at[new], words[new])
            self.from_ = np.insert(self.from_, at[new], old + np.cumsum(many) - many)
            self.many = np.insert(self.many, at[new], many)
            at = np.searchsorted(self.known, words)
        return at


_tokens: dict[str, Tokens] = {}


def tokens(vocabulary: str) -> Tokens:
    """One encoder per Python worker and vocabulary."""
    if vocabulary not in _tokens:
        _tokens[vocabulary] = Tokens(vocabulary)
    return _tokens[vocabulary]


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(vocabulary)
        encoder.forget()  # a worker serves other operators between two tasks, too
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        for column, value in zip(rows, (doc, k, at, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], PIECES.fieldNames())
        encoder.forget()

    return tidy(run)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    return input_columns(docs, "doc_id", "text").mapInArrow(_cut(vocabulary, capacity, end_id), PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all texts of (doc_id, text) into sequences of at most ``capacity`` ids."""
    cut = stage(token_pieces(docs, vocabulary, capacity), "pieces")
    return assign(cut, capacity)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``."""
    spark = cut.sparkSession
    # At most ``capacity`` rows: one for each length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(pack_counts(counts, capacity), PLACES)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")]
    ranked = numbered(cut, "length", order, "_number")
    # A few rows per length, so at most some ten thousand: small whatever the corpus.
    places = F.broadcast(places.withColumnRenamed("length", "_length"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("first")) & (F.col("_number") < F.col("first") + F.col("n"))
    return ranked.join(places, inside).select(
        *cut.columns, (F.col("sequence_first") + F.col("_number") - F.col("first")).alias("sequence_id"), "offset"
    )
