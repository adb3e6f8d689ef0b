"""Words and their hashes for a whole Arrow batch of texts at once.

Inside a task the texts of a batch are one byte buffer.  numpy finds word starts and
ends in it and hashes every word with one running sum, so no Python object is made
per word.  Buffers are cut into blocks between words, so the memory needed does not
depend on how long a text is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word is a run of ASCII letters and digits and of all other
# characters beyond ASCII; A-Z count as a-z.
WORD_RE = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

BLOCK_BYTES = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lower_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        if b >= 0x80 or (ch.isascii() and ch.isalnum()):
            table[b] = ord(ch.lower()) if b < 0x80 else b
    return table


LOWER = _lower_table()
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _U(_BASE))
    down = np.full(size, _U(_INVERSE))
    up[0] = down[0] = _U(1)
    return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for at least ``size`` places."""
    return _powers(max(BLOCK_BYTES, 1 << (size - 1).bit_length()) if size > 1 else BLOCK_BYTES)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every run, the same wherever the run stands."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: The word pattern once other signs than letters and marks beyond ASCII are separators too.
LETTER_RUN = r"[0-9A-Za-z\p{L}\p{M}]+"

# Signs beyond ASCII that are neither letters nor marks, by their length in bytes.
_SIGNS = [
    (r"[^\pL\pM\x{0}-\x{7F}\x{800}-\x{10FFFF}]", "  "),
    (r"[^\pL\pM\x{0}-\x{7FF}\x{10000}-\x{10FFFF}]", "   "),
    (r"[^\pL\pM\x{0}-\x{FFFF}]", "    "),
]


def letter_runs(texts: pa.Array) -> pa.Array:
    """The texts with typographic signs beyond ASCII as blanks, every letter at its old byte."""
    data, _ = buffer_of(texts)
    if not len(data) or int(data.max()) < 0x80:
        return texts
    for pattern, blanks in _SIGNS:
        texts = pc.replace_substring_regex(texts, pattern, blanks)
    return texts


class Words:
    """Words of a batch: hash, text number, and byte range of each; words per text."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffer_of(texts)
        n = len(self.offsets) - 1
        hashes, starts, ends = [], [], []
        edges = np.unique(self.offsets)
        at = 0
        while at < len(self.data):
            stop = self._cut(at, edges)
            h, s, e = self._block(at, stop, edges)
            hashes.append(h)
            starts.append(s)
            ends.append(e)
            at = stop
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        assert len(self.count) == n

    def _cut(self, at: int, edges: np.ndarray) -> int:
        stop, size = len(self.data), BLOCK_BYTES
        while at + size < stop:
            part = self.data[at : at + size]
            gaps = np.flatnonzero(LOWER[part] == 0)
            edge = edges[np.searchsorted(edges, at + size, "right") - 1]
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(edge))
            if cut > at:
                return cut
            size *= 2
        return stop

    def _block(self, at: int, stop: int, edges: np.ndarray):
        low = LOWER[self.data[at:stop]]
        is_word = low != 0
        inner = edges[(edges > at) & (edges < stop)] - at
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        before[inner] = False
        after = np.empty_like(is_word)
        after[-1], after[:-1] = False, is_word[1:]
        after[inner - 1] = False
        starts = np.flatnonzero(is_word & ~before)
        ends = np.flatnonzero(is_word & ~after) + 1
        return run_hashes(BYTE_VALUES[low], starts, ends), starts + at, ends + at

    def word(self, i: int) -> str:
        """The i-th word as text, in lower case."""
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace").lower()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the place of each."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        out = np.zeros(m, _U)
        for j in range(k):
            out += self.hash[j : m + j] * _U(pow(_INVERSE, 3 * j + 1, 1 << 64))
        keep = np.flatnonzero(self.text[:m] == self.text[k - 1 :])
        return mix(out[keep] ^ _U(k * 0x2545F4914F6CDD1D & (2**64 - 1))), keep

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """k-word hashes and their text numbers; a text of fewer words is one shingle."""
        hashes, at = self.grams(k)
        hashes, owner = [hashes], [self.text[at]]
        for n in range(1, k):
            short = np.flatnonzero(self.count == n)
            if len(short):
                part, place = self.grams(n)
                mine = np.isin(self.text[place], short)
                hashes.append(part[mine])
                owner.append(self.text[place][mine])
        return np.concatenate(hashes), np.concatenate(owner)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch whose texts have about ``limit`` bytes (one text at least)."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(batch):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(batch))
        yield batch.slice(at, stop - at)
        at = stop
