"""Words of a batch of texts as numpy arrays: byte ranges, document numbers and 64-bit hashes.

Separators are ASCII, so a UTF-8 text is cut into words on its bytes. Tasks work in pieces of
whole documents, a few MB at a time; one longer document is a piece of its own and takes about
40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: True for the bytes between words: space, \t, \n, \v, \f, \r.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Every byte as it is, and A-Z lowered.
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, PIECE_BYTES), self.base, dtype=np.uint64)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values[:n]


_up, _down = _Powers(_BASE), _Powers(_BASE_INVERSE)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets if len(offsets) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes (or of one document)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of ``n_docs`` texts in order. ``start`` and ``end`` are positions in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    hash: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def _runs(data: np.ndarray, inner: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators; a run ends at ``inner`` bounds."""
    word = ~separators[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def split_words(
    data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = AS_IS, separators: np.ndarray = WHITE
) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``, hashed after ``fold``."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint64))
    starts, ends = _runs(data, inner, separators)
    counts = np.diff(np.searchsorted(starts, offsets))
    sums = _BYTE_VALUE[fold][data]
    sums *= _up.upto(len(data))
    np.cumsum(sums, out=sums)
    first = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - first) * _down.upto(len(data))[starts])
    return Words(data, offsets, np.repeat(np.arange(len(counts)), counts), starts, ends, counts, hashes)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hashes of every ``n`` consecutive words of one document, and the number of
    the first word of each."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(words.doc[: total - n + 1] == words.doc[n - 1 :])
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(words.hash * _up.upto(total), out=sums[1:])
    return mix((sums[first + n] - sums[first]) * _down.upto(total)[first]), first


def covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each of ``total`` words that lies in a window of ``n`` words starting at one of ``first``."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + n, total), -1)
    return np.cumsum(steps[:-1]) > 0


def by_document(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES):
    """Pieces of the incoming batches: (rows of the piece, its bytes, its offsets)."""
    for batch in batches:
        data, offsets = texts(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in pieces(offsets, limit):
            yield batch.slice(lo, hi - lo), data, offsets[lo : hi + 1]
