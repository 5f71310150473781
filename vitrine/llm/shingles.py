"""Words and word shingles of Arrow text columns as 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each row; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 1 << 20), _STEP, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table)
    return _powers[:n]


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        table = np.full(max(n, 1 << 20), _INVERSE, np.uint64)
        table[0] = 1
        _inverses = np.cumprod(table)
    return _inverses[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and one more for the end).

    A word is a run of bytes other than space and 09-0D, with A-Z lower-cased.
    """
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:] | first[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[lower] * powers(len(data)), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse_powers(len(data))[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in text order, index of the first shingle of each row and the end).

    A row with fewer than ``size`` words has its whole sequence as its one shingle, a row
    without words none.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(begin[-1]), np.uint64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            rolled = rolled * _BASE + words[j : j + len(rolled)]
        rolled = mix(rolled)
        row = np.repeat(np.arange(len(counts)), n)
        index = first[:-1][row] + np.arange(len(out)) - begin[:-1][row]
        full = counts[row] >= size
        out[full] = rolled[index[full]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.uint64(0)
        for w in words[first[r] : first[r + 1]]:
            h = mix(np.array([h ^ w]) + _STEP)[0]
        out[begin[r]] = h
    return out, begin


def distinct_per_row(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(begin)))
