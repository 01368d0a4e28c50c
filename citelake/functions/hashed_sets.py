"""Shingle sets of Arrow texts as hashes, computed with numpy where they are needed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is hashed by itself.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
#: ASCII white space with the separators, and the other Unicode white space as (first bytes, least and most last byte) of its UTF-8.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE = ((b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A), (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _spaces(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to white space, as :func:`citelake.functions.text.words` takes it."""
    space = _SPACE[data]
    if len(data) and data.max() >= 0x80:
        for head, least, most in _WIDE:
            at = np.flatnonzero(data[: len(data) - len(head)] == head[0])
            for step, byte in enumerate(head[1:], 1):
                at = at[data[at + step] == byte]
            last = data[at + len(head)]
            at = at[(last >= least) & (last <= most)]
            for step in range(len(head) + 1):
                space[at + step] = True
    return space


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    steps = [np.full(size, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    for x in steps:
        x[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes of ``k`` words, in order, and where each row's begin."""
    inside = ~_spaces(data)
    edge = np.zeros(len(data) + 1, bool)  # a word ends with its row
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    # a word's hash: (C[end] - C[start]) / base^start, with C the running sum of byte values times powers of the base
    powers, inverse = _powers(max(CHUNK, 1 << len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    count = max(0, len(hashes) - k + 1)
    found = mix(hashes[:count] + np.uint64(0x632BE59BD9B4E019))
    for step in range(1, k):
        found = mix(found * np.uint64(0x9FB21C651E98DF25) + hashes[step : step + count])
    whole = row[:count] == row[k - 1 :][:count]
    found, row = found[whole], row[:count][whole]
    begins = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[fresh], np.searchsorted(row[fresh], np.arange(len(offsets)))


def hashed_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, members, begins) of runs of rows: row r's set is ``members[begins[r - first] : begins[r - first + 1]]``, in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        own = offsets[first : end + 1]
        yield first, end, *_sets(data[own[0] : own[-1]], own - own[0], k)
        first = end


def digests(members: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(members) + 1, np.uint64)
        np.cumsum(mix(members ^ np.uint64(seed)), out=total[1:])
        out.append(total[begins[1:]] - total[begins[:-1]])
    return out[0], out[1]
