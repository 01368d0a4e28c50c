"""Text batches as arrays of code points, with letter and lower-case tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 1 << 19
_SPAN = 0x10000  # the tables cover the basic plane; letters beyond it keep their case


def code_point_chunks(texts: list[str | None], max_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of runs of whole texts with about ``max_chars``; null is empty."""
    first, held, total = 0, [], 0
    for n, text in enumerate(texts):
        held.append(text or "")
        total += len(held[-1])
        if total >= max_chars or n == len(texts) - 1:
            points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
            yield first, n + 1, points, offsets
            first, held, total = n + 1, [], 0


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: whether it is a letter, and its lower case."""
    chars = [chr(i) for i in range(_SPAN)]
    letters = np.array([c.isalpha() for c in chars])
    lower = np.arange(_SPAN, dtype=np.uint32)
    for i, c in enumerate(chars):
        if letters[i] and c.isupper() and len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return letters, lower


def letters_lowered(points: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and all of them lower-cased."""
    letters, lower = tables
    basic = points < _SPAN
    if basic.all():
        return letters[points], lower[points]
    near = np.where(basic, points, 0)
    is_letter = letters[near]
    far = np.flatnonzero(~basic)
    is_letter[far] = [chr(c).isalpha() for c in points[far].tolist()]
    return is_letter, np.where(basic, lower[near], points)
