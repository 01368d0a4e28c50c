"""All periodic stretches (runs) of each text's words, from its Lempel-Ziv blocks.

Many texts are handled at once, as one sequence in which no two texts share a word name:

1. Names of all stretches of 1, 2, 4 .. words, each level from the one before, sorted until no two positions bear the same
   name.  The last order is the suffix array; two positions are compared forward or backward by descending the levels.
2. LCP of neighbours in that order, and for each position the nearest earlier positions on either side of it, by
   pointers that jump over each other's targets: the larger common prefix is the longest previous factor (LPF).
3. Blocks: a position and its longest previous factor, or one new word.
4. A run that crosses or touches a boundary of blocks, has its last boundary where a block of u words begins, follows a
   block of v words, and has a period of at most u + v (else the block before would have been longer).  For each
   such period the words are extended from the boundary to both sides.
5. A run strictly inside a block is the copy of one in the block's earlier occurrence, and is copied from there; runs
   lie in buckets by their first word, taken in order.

Work is n log n for n words of a text (a level's sort only holds positions that still share a name) plus the runs found.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.filter_audit import word_counts
from citelake.llm.words import WordHasher, mix, text_chunks
from citelake.llm.worker import tidy

#: Words of the shortest run told.
LEAST = 12


class Suffixes:
    """Suffix array of a sequence of texts and names of its stretches of 2^k words.

    ``keys`` names the words, those of different texts differently; ``ends`` gives the end of each word's text.
    """

    def __init__(self, keys: np.ndarray, ends: np.ndarray):
        n = len(keys)
        order = np.argsort(keys)
        fresh = np.ones(n, bool)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        head = np.flatnonzero(fresh)
        sizes = np.diff(np.append(head, n))
        names = np.full(n + 1, -1, np.int32)
        names[order] = np.repeat(head, sizes)
        self.order, self.levels = order, [names]
        #: the level whose names slots r - 1 and r share last (-1: none)
        self.shared = np.full(n, -1, np.int8)
        slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
        while len(slots):
            level = len(self.levels) - 1
            at = order[slots]
            then = at + (1 << level)
            # where the text ends with the stretch, no other of the same name does
            key = names[at].astype(np.int64) << 32 | np.where(then < ends[at], names[np.minimum(then, n)] + 1, 0)
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            parted = fresh.copy()
            parted[0] = False
            parted[1:] &= key[1:] >> 32 == key[:-1] >> 32
            self.shared[slots[parted]] = level
            names = names.copy()
            names[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            self.levels.append(names)
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            slots = slots[~alone]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j (i != j) on are the same."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            length += (names[i + length] == names[j + length]).astype(np.int64) << level
        return length

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j (i < j) are the same."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, back = self.levels[level], i - length - (1 << level)
            same = (names[np.maximum(back, 0)] == names[np.maximum(j - length - (1 << level), 0)]) & (back >= 0)
            length += same.astype(np.int64) << level
        return length

    def neighbours_common(self) -> np.ndarray:
        """LCP: how many words the suffixes of slots r - 1 and r share; one entry more than there are slots."""
        out = np.zeros(len(self.order) + 1, np.int64)
        rows = np.flatnonzero(self.shared >= 0)
        last, i, j = self.shared[rows], self.order[rows - 1], self.order[rows]
        length = np.int64(1) << last.astype(np.int64)
        for level in range(int(last.max(initial=0)) - 1, -1, -1):
            some, names = np.flatnonzero(last > level), self.levels[level]
            same = names[i[some] + length[some]] == names[j[some] + length[some]]
            length[some[same]] += 1 << level
        out[rows] = length
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF of each position, and where that factor stands earlier."""
        order, n = self.order, len(self.order)
        lcp = self.neighbours_common()
        best, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in (-1, 1):
            to = np.arange(n) + step
            shared = lcp[:n].copy() if step < 0 else lcp[1:].copy()
            live = np.flatnonzero(shared > 0)
            live = live[order[to[live]] > order[live]]
            while len(live):
                over = to[live]
                less, beyond = np.minimum(shared[live], shared[over]), to[over]
                shared[live], to[live] = less, beyond
                live = live[less > 0]
                live = live[order[to[live]] > order[live]]
            more = np.flatnonzero(shared > best)
            best[more], where[more] = shared[more], order[to[more]]
        factor, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        factor[order], source[order] = best, where
        return factor, source


def _blocks(factor: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block starts of all texts (each with a word), each text's followed by its end, and the places of these ends."""
    after = (np.maximum(factor, 1) + np.arange(len(factor))).tolist()
    out, closes = [], []
    for at, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        while at < end:
            out.append(at)
            at = after[at]
        closes.append(len(out))
        out.append(end)
    return np.array(out, np.int64), np.array(closes, np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry and the number 1 .. count of each of ``counts`` repetitions."""
    entry = np.repeat(np.arange(len(counts)), counts)
    return entry, np.arange(1, len(entry) + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def _at_boundaries(suffixes: Suffixes, bounds: np.ndarray, begins: np.ndarray, closes: np.ndarray, least: int) -> np.ndarray:
    """Runs that cross or touch a boundary, as rows (start, end, period); some are told repeatedly or with multiples of their period."""
    length = np.append(np.diff(bounds), 0)
    length[closes] = 0
    before = np.zeros(len(bounds), np.int64)
    before[1:] = np.diff(bounds)
    inner = np.flatnonzero(bounds > begins)
    at, length, before, begins = bounds[inner], length[inner], before[inner], begins[inner]
    # the two sides of a run share at least ``least`` / 2 words, so one of them this many of one name
    level = max(0, (-(-least // 4)).bit_length() - 1)
    if level >= len(suffixes.levels):
        return np.zeros((0, 3), np.int64)
    names, far, found = suffixes.levels[level], 1 << level, []
    for leftward in (True, False):
        entry, period = _spread(np.minimum(length + before, at - begins) if leftward else np.maximum(length - 1, 0))
        i = at[entry] - period if leftward else at[entry]
        back = i - far
        likely = (names[i] == names[i + period]) | ((names[np.maximum(back, 0)] == names[back + period]) & (back >= 0))
        i, period = i[likely], period[likely]
        after, ahead = suffixes.common(i, i + period), suffixes.common_before(i, i + period)
        run = (after + ahead >= period) & (after + ahead + period >= least)
        found.append(np.stack([i - ahead, i + period + after, period], 1)[run])
    return np.concatenate(found)


def _with_copies(found: np.ndarray, factor: np.ndarray, source: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs of ``found`` once each, with the smallest period, and those strictly inside blocks, by start and end."""
    buckets: dict[int, dict[int, int]] = {}
    for start, end, period in found[np.lexsort((-found[:, 2],))].tolist():
        buckets.setdefault(start, {})[end] = period
    starts = sorted(buckets)
    wide = bounds[:-1][np.diff(bounds) >= least + 2] if buckets else bounds[:0]
    for block, size, earlier in zip(wide.tolist(), factor[wide].tolist(), source[wide].tolist(), strict=True):
        move, k = block - earlier, bisect_right(starts, earlier)
        while k < len(starts) and starts[k] < earlier + size:
            inside = [(end, period) for end, period in buckets[starts[k]].items() if end < earlier + size]
            if inside:
                start = starts[k] + move
                if start not in buckets:
                    buckets[start] = {}
                    insort(starts, start)
                for end, period in inside:
                    buckets[start].setdefault(end + move, period)
            k += 1
    return [(start, end, period) for start in starts for end, period in sorted(buckets[start].items())]


def find_runs(keys: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of ``least`` words or more, as rows (start, end, period) by start and period; ``first`` cuts ``keys`` into texts.

    A run is a stretch of at least two periods, of its smallest period, that no neighbouring word extends.  Texts must
    not share keys.
    """
    first = np.unique(first)  # without empty texts
    if len(keys) < least:
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(keys, np.repeat(first[1:], np.diff(first)))
    factor, source = suffixes.previous_factors()
    bounds, closes = _blocks(factor, first)
    begins = np.repeat(first[:-1], np.diff(np.append(-1, closes)))
    found = _at_boundaries(suffixes, bounds, begins, closes, least)
    runs = np.array(_with_copies(found, factor, source, bounds, least), np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    starts, ends = starts[keep], ends[keep]
    joined = np.zeros(len(starts), np.int64)  # one byte after each word but a text's last: some white space that becomes the space
    joined[:-1] = text[1:] == text[:-1]
    edges = np.zeros(len(data) + 2, np.int8)
    edges[starts] += 1
    np.subtract.at(edges, ends + joined, 1)
    taken = np.cumsum(edges[: len(data)], dtype=np.int8).astype(bool)
    body = data.copy()
    body[ends[joined == 1]] = 32
    sizes = np.bincount(text, ends + joined - starts, len(first) - 1).astype(np.int64)
    return body[taken], np.concatenate([[0], np.cumsum(sizes)])


def _run_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = hasher.words(data, offsets)
                text = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(first))
                keys = mix(hasher.spans(hasher.sums(data), starts, ends) ^ mix(text + np.uint64(1)))
                runs = find_runs(keys, first, least)
                covered = np.zeros(len(keys) + 1, np.int64)
                np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
                np.subtract.at(covered, runs[:, 1], 1)
                body, where = _collapsed(data, starts, ends, first, np.cumsum(covered)[:-1] == 0)
                of = np.searchsorted(runs[:, 0], first)
                begin = first[:-1][np.repeat(np.arange(b - a), np.diff(of))]
                fields = [runs[:, 0] - begin, runs[:, 1] - runs[:, 0], runs[:, 2]]
                told = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["start", "length", "period"])
                text = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(where), pa.py_buffer(body))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), told), text.cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row; ``runs`` are (start, length, period) in words by start, then period.

    Words are runs of other than ASCII white space, numbered from 0.  A run is a stretch of ``least`` words or more that repeats
    its first ``period`` words (the smallest such number) at least once whole, and that no neighbouring word extends.
    ``collapsed`` is the text without the words that any run holds after its first period, joined by one space.  A null text
    is empty: no words, no runs, an empty ``collapsed``.  Rows are judged by themselves, so equal rows give equal rows,
    null ids stay and an empty table gives an empty one; other columns are not read, so names cannot clash.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return named.mapInArrow(tidy(_run_batches(least)), schema).withColumnRenamed("id", id_col)


def repeat_tail(text: Column, start: Column, period: Column) -> Column:
    """``text`` whose words from number ``start(n)`` on repeat ``period(n, start)`` words, joined by one space; n words, at least one.

    ``start`` and ``period`` are functions of columns.  A text without words is given back as it is.
    """
    words, some = word_counts(text)

    def edited(found: Column) -> Column:
        n = F.size(found).cast("long")
        a = start(n)
        p = period(n, a)
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when(some, F.transform(F.array(words), edited)[0]).otherwise(text)
