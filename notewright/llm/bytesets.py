"""Vectorised word and shingle hashing over Arrow string buffers.

Every function works on the UTF-8 bytes of a whole batch of texts at once, so
no Python object is made per word.  Hashes are 64 bits wide: within a corpus of
n distinct values, some two of them collide with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_POW_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow = np.ones(1, dtype=U64)


def _powers(n: int) -> np.ndarray:
    """_POW_BASE ** 0 .. n-1 modulo 2^64, kept between calls."""
    global _pow
    if len(_pow) < n:
        out = np.full(max(n, 1024), _POW_BASE, dtype=U64)
        out[0] = 1
        _pow = np.multiply.accumulate(out)
    return _pow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`; a larger row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class Words:
    """Words of a batch of texts: byte spans, hashes, and the word range of each text.

    `separators` marks the bytes that are in no word; A-Z are lowered first.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True):
        self.n = len(offsets) - 1
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offsets))
        edges = offsets[:-1][full]
        first[edges] = inside[edges]
        edges = offsets[1:][full] - 1
        last[edges] = inside[edges]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.bounds = np.searchsorted(self.start, offsets)
        self._bytes = (LOWER[data] if lower else data)[inside]

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U64)
        begin = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        place = np.arange(len(self._bytes)) - np.repeat(begin, self.length)
        value = (self._bytes.astype(U64) + U64(1)) * _powers(int(self.length.max()))[place]
        return mix(np.add.reduceat(value, begin) + self.length.astype(U64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(size):
        out += h[j : j + n] * (_SHINGLE_MULT[j % 5] + U64(2 * (j // 5)))
    return mix(out)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its word shingles.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    h = words.hashes()
    runs = window_hashes(h, size)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield window_hashes(h[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)
