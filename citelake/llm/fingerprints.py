"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes decides where a chunk ends: before ``NORMAL`` bytes a strict mask must be
zero, from there a lax one, never before ``LEAST`` bytes and always at ``MOST``.  Boundaries depend on content
nearby only, so an edit changes the chunks it touches and those after it fall back into step.  A fingerprint is
the sorted set of a text's chunks, each as 48 digest bits and 16 bits of length, in hexadecimal; containment of
one in another is the share of its length in chunks that the other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.scratch import shuffle_partitions
from citelake.llm.words import CHUNK_BYTES, WordHasher, mix

LEAST, NORMAL, MOST = 32, 96, 384
STRICT_BITS, LAX_BITS = 8, 5
#: More ranges than this are not made, however many rows there are (they are plan literals).
MOST_RANGES = 100_000


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of the texts in ``data``, and the number of each text's first chunk (one more than texts)."""
    gear = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    h = gear[data]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    lax = np.flatnonzero(h >> np.uint32(32 - LAX_BITS) == 0)
    strict = lax[h[lax] >> np.uint32(32 - STRICT_BITS) == 0] + 1
    lax += 1  # cuts: the chunk ends before this byte

    starts = np.concatenate([offsets[:-1], lax])
    none = np.iinfo(np.int64).max

    def first_from(cuts: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(cuts, at)
        return np.append(cuts, none)[place]

    early = first_from(strict, starts + LEAST)
    late = first_from(lax, starts + NORMAL)
    cut = np.where(early < starts + NORMAL, early, np.minimum(late, starts + MOST))
    place = np.searchsorted(lax, cut)
    place = np.where((place < len(lax)) & (np.append(lax, -1)[place] == cut), place, -1)
    cut_of, place_of, rows = cut.tolist(), place.tolist(), len(offsets) - 1
    ends: list[int] = []
    first = [0]
    for row, (a, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at, node = a, row
        while at < end:
            if node >= 0:
                at, follow = cut_of[node], place_of[node]
                node = follow + rows if follow >= 0 else -1
            else:  # after a cut that the length forced
                i = int(np.searchsorted(strict, at + LEAST))
                soon = int(strict[i]) if i < len(strict) else none
                if soon >= at + NORMAL:
                    i = int(np.searchsorted(lax, at + NORMAL))
                    soon = min(int(lax[i]) if i < len(lax) else none, at + MOST)
                at = soon
                i = int(np.searchsorted(lax, at))
                node = i + rows if i < len(lax) and lax[i] == at else -1
            ends.append(min(at, end))
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first, np.int64)


def chunk_sets(texts: list[bytes], hasher: WordHasher) -> list[np.ndarray]:
    """Each text's sorted distinct chunks: digest in the upper 48 bits, length in the lower 16."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ends, first = chunk_ends(data, offsets)
    starts = np.empty(len(ends), np.int64)
    if len(ends):
        starts[1:] = ends[:-1]
        has = np.flatnonzero(np.diff(first))
        starts[first[has]] = offsets[has]
    packed = hasher.spans(hasher.sums(data), starts, ends) & np.uint64(0xFFFFFFFFFFFF0000) | (ends - starts).astype(np.uint64)
    return [np.unique(packed[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def as_text(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of ``own``'s length in chunks that ``other`` has; two empty texts are alike, an empty and another are not."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    theirs = set(other.tolist())
    mine = own.tolist()
    return sum(c & 0xFFFF for c in mine if c in theirs) / sum(c & 0xFFFF for c in mine)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` for every row, in one pass without a shuffle; a null text counts as empty.

    Equal texts have equal fingerprints, so repeated rows are told alike; an empty text has the empty fingerprint and an
    empty table an empty result.  Only the named columns are read, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _portions([len(t) for t in texts]):
                prints = [as_text(c) for c in chunk_sets(texts[a:b], hasher)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _portions(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for n, size in enumerate(sizes):
        total += size
        if total >= most or n == len(sizes) - 1:
            yield first, n + 1
            first, total = n + 1, 0


def _range_of(value: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` are not above ``value`` (null: none), in about two square roots of them."""
    if not splits:
        return F.lit(0)
    width = isqrt(len(splits)) + 1
    heads = F.array(*[F.lit(s) for s in splits[::width]])
    every = F.array(*[F.lit(s) for s in splits])
    coarse = F.size(F.filter(heads, lambda s: s <= value))
    inside = F.size(F.filter(F.slice(every, F.greatest(F.lit(0), coarse - 1) * width + 1, width), lambda s: s <= value))
    return F.coalesce(F.when(coarse > 0, (coarse - 1) * width + inside), F.lit(0))


_EDITED = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (id, range, extra, text) to each row that is not extra against the row after it."""
    hasher = WordHasher()

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All rows but the last, which is only looked at."""
        own = chunk_sets([t.encode() for t in texts], hasher)
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        theirs = chunk_sets(edited, hasher)
        columns = [
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t).hexdigest() for t in edited],
            [as_text(c) for c in own[:-1]],
            [as_text(c) for c in theirs],
            [containment(a, b) for a, b in zip(own, theirs, strict=False)],
            [containment(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        arrays = [pa.array(v, kind) for v, (_, kind) in zip(columns, _EDITED, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *arrays], names=["id", *[n for n, _ in _EDITED]])

    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)
        for doc_id, extra, text in rows:
            # the second of two extra rows follows no row that needs it
            if not extra or ids:
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
            if extra or held >= CHUNK_BYTES:
                if len(ids) > 1:
                    yield compared(ids, texts)
                ids, texts, held = ([], [], 0) if extra else (ids[-1:], texts[-1:], 0)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next text, for every row.

    The next row is the next in order of id (null first, equal ids by a hash of the text); the last one's is the
    first.  The edited form has its last ``floor(n / 2)`` code points replaced by the first as many of the next
    text (or all of it).  A null text counts as empty.  ``near_edited`` and ``near_next`` are containments of
    the text in the edited and in the next one.  An empty table gives an empty result.

    Texts are shuffled once, into ranges of ids; the first row of each range also goes to the end of the range
    before it, so every row meets its next one where it is.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ids = named.select("id")
    ranges = min(MOST_RANGES, max(shuffle_partitions(spark), -(-ids.count() // 20_000)))
    points = [k / ranges for k in range(1, ranges)]
    found = ids.where("id is not null").approxQuantile("id", points, 1 / (8 * ranges)) if ranges > 1 else []
    splits = sorted({int(x) for x in found})
    rows = named.withColumn("range", _range_of(F.col("id"), splits)).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    firsts = sorted(rows.groupBy("range").agg(F.min(order).alias("f")).collect())  # one small row for each range
    before = [(r["range"], firsts[n - 1]["range"], r["f"]["id"], r["f"]["tie"]) for n, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "_range int, _before int, _id long, _tie long")
    is_head = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("extra"))
    also = F.struct(F.col("_before").alias("range"), F.lit(1).alias("extra"))
    rows = rows.join(F.broadcast(heads), F.col("range") == F.col("_range"))
    placed = rows.select("id", "text", "tie", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("id", F.col("p.range").alias("range"), F.col("p.extra").alias("extra"), "text", "tie")
    dealt = placed.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions("range", "extra", "id", "tie").drop("tie")
    return dealt.mapInArrow(_compare_batches, schema).withColumnRenamed("id", id_col)
