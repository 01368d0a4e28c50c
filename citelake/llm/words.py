"""Vectorised splitting and hashing of Arrow text batches, for functions that run in executors' Python.

Words are maximal runs of bytes other than the space and the ASCII controls tab to carriage return.  Their
hashes come from one running sum over the batch: with byte values T and powers of an odd base B modulo 2^64,
``(C[end] - C[start]) * B^-start`` depends on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``max_bytes`` of text; a null is empty.

    A text is never cut: one that is longer makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    rows = len(column)
    if not rows:
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        end = min(rows, max(first + 1, end))
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


class WordHasher:
    """Hashes of words, by position, for batches of any size."""

    def __init__(self, lower_ascii: bool = False):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if lower_ascii:
            values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << int(n - 1).bit_length()
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums C, one more than there are bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end)."""
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of the first word of each row (one more than rows)."""
        inside = ~self.space[data]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        before = np.empty(len(data), bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(len(data), bool)
        after[-1], after[:-1] = True, ~inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = True
        starts = np.flatnonzero(inside & before)
        return starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's k-word shingles, sorted within the row, and where each row's begin.

    A row of 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(first_word)
    row = np.repeat(np.arange(len(counts)), counts)
    left = first_word[1:][row] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    acc = mix(words + np.uint64(0x632BE59BD9B4E019))
    for step in range(1, k):
        reach = np.flatnonzero(left > step)
        acc[reach] = mix(acc[reach] * np.uint64(0x9FB21C651E98DF25) + words[reach + step])
    valid = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    valid[first_word[:-1][short]] = True
    hashes, row = acc[valid], row[valid]
    begins = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], np.searchsorted(row[fresh], np.arange(len(counts) + 1))


def row_sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each row's values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]
