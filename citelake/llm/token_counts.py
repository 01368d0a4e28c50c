"""Edit-aware token counts.

A document's pre-tokens stand in slots at the leaves of a segment tree whose nodes sum characters and tokens.  An
edit descends to the slot it starts in, re-splits from the first pre-token that can see the edit (the pattern looks
one character past the end of a match, never behind its start) until a boundary coincides with an old one behind
the edit, counts only those pre-tokens, replaces them in the slots they were in and updates the sums above.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.worker import once

SLOT = 64
#: A slot that has grown to this many times its size makes the tree deal its slots anew.
OVERFULL = 4
#: How far past its end the pattern looks before it decides on a match.
LOOKAHEAD = 1
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000
#: The pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, pretokens: Sequence[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, pretokens))
        if None in out:
            encode = self.encoding.encode_ordinary
            for n, (count, piece) in enumerate(zip(out, pretokens, strict=True)):
                if count is None:
                    out[n] = known[piece] = len(encode(piece))
        return out


class TokenTree:
    """A text, its pre-tokens and a segment tree over slots of them."""

    def __init__(self, text: str, counter: Counter, slot: int = SLOT):
        self.text, self.counter, self.slot = text, counter, slot
        self.recounted = 0
        pieces = counter.pattern.findall(text)
        self._deal(list(map(len, pieces)), counter.counts(pieces))

    def _deal(self, sizes: list[int], counts: list[int]) -> None:
        step = self.slot
        self.sizes = [sizes[k : k + step] for k in range(0, len(sizes), step)] or [[]]
        self.counts = [counts[k : k + step] for k in range(0, len(counts), step)] or [[]]
        width = 1 << (len(self.sizes) - 1).bit_length()
        chars, tokens = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
        chars[width : width + len(self.sizes)] = [sum(s) for s in self.sizes]
        tokens[width : width + len(self.counts)] = [sum(c) for c in self.counts]
        level = width
        while level > 1:
            for sums in (chars, tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        self.width, self.chars, self.tokens = width, chars.tolist(), tokens.tolist()

    @property
    def total(self) -> int:
        """Tokens of the whole text."""
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """The slot that holds character ``place`` (the last one, behind the end) and where it starts."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` by ``insert``; places beyond the text count as its end."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(start + length, len(self.text)))
        old_length = len(self.text)
        self.text = self.text[:start] + insert + self.text[stop:]
        shift = len(self.text) - old_length

        # the first pre-token that can see the edit: its end is not before start - LOOKAHEAD
        slot, at = self._find(max(0, start - LOOKAHEAD - 1))
        inside = 0
        while inside < len(self.sizes[slot]) and at + self.sizes[slot][inside] < start - LOOKAHEAD:
            at += self.sizes[slot][inside]
            inside += 1
        # walk old boundaries and new matches in step until they meet behind the edit
        last, taken, old_at = slot, inside, at
        fresh: list[str] = []
        new_at = at
        matches = self.counter.pattern.finditer(self.text, at)

        def next_old() -> bool:
            nonlocal last, taken, old_at
            while last < len(self.sizes) and taken >= len(self.sizes[last]):
                last, taken = last + 1, 0
            if last >= len(self.sizes):
                return False
            old_at += self.sizes[last][taken]
            taken += 1
            return True

        while True:
            while old_at < stop or old_at + shift < new_at:
                if not next_old():
                    break
            if old_at >= stop and old_at + shift == new_at and new_at >= start + len(insert):
                break
            match = next(matches, None)
            if match is None:
                while next_old():
                    pass
                break
            fresh.append(match.group())
            new_at = match.end()
        self.recounted += sum(map(len, fresh))
        last = min(last, len(self.sizes) - 1)
        upto = len(self.sizes[last]) if old_at >= old_length else taken
        if last == slot:
            self._replace(slot, inside, max(inside, upto), fresh)
        else:
            self._replace(slot, inside, len(self.sizes[slot]), fresh)
            for k in range(slot + 1, last):
                self._replace(k, 0, len(self.sizes[k]), [])
            self._replace(last, 0, upto, [])
        if len(self.sizes[slot]) > OVERFULL * self.slot:
            self._deal([s for x in self.sizes for s in x], [c for x in self.counts for c in x])

    def _replace(self, slot: int, a: int, b: int, pieces: list[str]) -> None:
        """Put ``pieces`` in the place of a slot's pre-tokens a to b, and update the sums above."""
        sizes, counts = list(map(len, pieces)), self.counter.counts(pieces)
        chars = sum(sizes) - sum(self.sizes[slot][a:b])
        tokens = sum(counts) - sum(self.counts[slot][a:b])
        self.sizes[slot][a:b] = sizes
        self.counts[slot][a:b] = counts
        node = slot + self.width
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


def _digest(ranks: dict[bytes, int], pattern: str) -> str:
    """What tells a vocabulary and its pattern from all others."""
    found = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        found.update(b"%d %d " % (rank, len(token)) + token)
    return found.hexdigest()


def count_edited(
    docs: DataFrame, edits: Column, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN
) -> DataFrame:
    """``id, n_chars, n_tokens, edited_chars, edited_tokens, recounted_chars`` for every row.

    ``edits`` is an array of (start long, length long, insert string), applied in order, each to the text that the
    ones before it left; a null array or element changes nothing.  A null text counts as empty, an empty one has no
    token.  Every row is counted by itself, so repeated rows and ids give a row each, ties cannot occur and an empty
    table gives an empty result; other columns are not read, so clashing names do no harm.  Rows are counted where they
    were scanned, without a shuffle.  Each edit re-splits its surroundings only, but copies the text once.
    """
    name = f"counter {_digest(ranks, pattern)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(name, lambda: Counter(ranks, pattern))
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", counter)
                before = (len(tree.text), tree.total)
                for change in changes.as_py() or []:
                    if change is not None:
                        tree.edit(change["start"] or 0, change["length"] or 0, change["insert"] or "")
                out.append((*before, len(tree.text), tree.total, tree.recounted))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            names = ["id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "recounted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), edits.alias("edits"))
    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, recounted_chars long"
    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sample_edits(text: Column) -> Column:
    """Three edits of each text: a cut of up to 8 characters at a third, an insertion at a half, and a copy of the
    first 12 characters at the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def change(start: Column, length: int, insert: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))

    return F.array(
        change(F.floor(n / 3), 8, F.lit("")),
        change(F.floor(n / 2), 0, F.lit(" revised")),
        change(n + 8, 0, F.substring(F.coalesce(text, F.lit("")), 1, 12)),
    )
