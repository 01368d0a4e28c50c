"""Documents whose word n-gram sets have a Jaccard similarity of at least a threshold, by partition enumeration.

Sizes are cut into bands [2^j, 2^(j+1)).  The domain of n-grams (64-bit hashes) is cut into as many parts as a fixed share of
a band's largest size, by the leading bits of the hash, and a set's signatures in a band are its projections on the
parts.  Linked sets of sizes a and b differ in at most (a + b) * (100 - percent) / (100 + percent) elements, so at
most that many parts, k, have different projections.  Of all signatures in one order for everyone (projections of many
elements first, empty ones last, else by hash), linked sets therefore share one among the first k + 1 of either: of n
signatures at least n - k are in common.  Only these are told.  A set whose partner can lie in the next band is
signed in that band too.

Empty projections are never told.  A set with at most k projections that are not empty (rare, as there are more parts than k) also
tells its k + 1 smallest elements: two such sets share one of these, and a set with more has k + 1 signatures that are
not empty.  So no link is lost, whatever the texts, and signatures of one common n-gram come last.

Sets that share a signature are compared as in :mod:`citelake.llm.near_dedup`: one member of each class of equal sets,
leaders first, then by their exact differences, every link confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.bitmap import bitmap_of, possible
from citelake.llm.near_dedup import _components, _lists, _set_batches
from citelake.llm.scratch import Scratch
from citelake.llm.words import WordHasher, mix, row_sums, shingle_hashes, text_chunks
from citelake.llm.worker import tidy

SHINGLE = 5
PERCENT = 80
#: Parts of the domain in eighths of a band's largest size: more than k of them are not empty, and most hold two elements or more.
PARTS = 3
FEWEST_PARTS = 8


def _signed(hashes: np.ndarray, begins: np.ndarray, rows: np.ndarray, band: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of ``rows`` in ``band`` that are told, and the row of each; ``most`` differences part a row from a partner."""
    sizes = np.diff(begins)[rows]
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = np.maximum(FEWEST_PARTS, ((np.int64(2) << band) - 1) * PARTS // 8)
    entry = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[:-1][rows][entry]
    members = hashes[at]  # sorted within a row, so each part's stand together
    part = (members >> np.uint64(32)) * parts[entry].astype(np.uint64) >> np.uint64(32)
    fresh = np.ones(len(entry), bool)
    fresh[1:] = (entry[1:] != entry[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(entry)))
    sums = np.add.reduceat(mix(members ^ np.uint64(0x5851F42D4C957F2D)), head)
    place = part[head] << np.uint64(8) | band[entry[head]].astype(np.uint64)
    low = mix(sums + mix(place + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(8)
    tokens = (np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56) | low
    owner = entry[head]
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        tokens[a:b].sort()
    told = np.arange(len(tokens)) - first[owner] <= most[owner]
    thin = np.diff(first) <= most
    element = thin[entry] & (at - begins[:-1][rows][entry] <= most[entry])
    own = mix(members[element] ^ mix(band[entry[element]].astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))) | np.uint64(255) << np.uint64(56)
    return np.concatenate([tokens[told], own]), rows[np.concatenate([owner[told], entry[element]])]


def signatures(hashes: np.ndarray, begins: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All signatures that are told of each row's sorted set of hashes, and where each row's begin.

    Rows whose set can only link to an equal one have none.
    """
    sizes = np.diff(begins)
    larger = sizes * 100 // percent
    rows = np.flatnonzero(larger > sizes)
    band = np.frexp(sizes[rows].astype(float))[1].astype(np.int64) - 1
    top = (np.int64(2) << band) - 1  # the largest size of the band
    differ = lambda a, b: (a + b) * (100 - percent) // (100 + percent)
    own = _signed(hashes, begins, rows, band, differ(sizes[rows], np.minimum(larger[rows], top)))
    over = larger[rows] > top
    after = _signed(hashes, begins, rows[over], band[over] + 1, differ(sizes[rows[over]], larger[rows[over]]))
    tokens, row = np.concatenate([own[0], after[0]]), np.concatenate([own[1], after[1]])
    order = np.argsort(row, kind="stable")
    return tokens[order], np.searchsorted(row[order], np.arange(len(sizes) + 1))


def _signature_batches(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower_ascii=True)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = hasher.words(data, offsets)
                hashes, begins = shingle_hashes(hasher.spans(hasher.sums(data), starts, ends), first, shingle)
                tokens, where = signatures(hashes, begins, percent)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(begins)),
                        pa.array(row_sums(mix(hashes), begins).view(np.int64)),
                        pa.array(row_sums(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), begins).view(np.int64)),
                        _lists(tokens, where),
                    ],
                    names=["id", "n", "d1", "d2", "tokens"],
                )

    return run


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row.

    Words are runs of other than ASCII white space, with A-Z lower-cased; a text's set are its distinct runs of ``shingle``
    words, or its whole sequence if that is shorter; without words (or null) the set is empty and links with nothing.
    Documents link when ``100 * shared >= percent * union``; ``component_id`` is the smallest id reachable by links.  Rows that
    repeat an id are one document: links of any of them count for the id.  A row without an id links to nothing
    (component null).  An empty table gives an empty result.  Only the two named columns are read, so names of others
    cannot clash.  ``percent`` is 50 to 100, so that a partner lies in the same band of sizes or the next.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    scratch = Scratch(docs.sparkSession, "ngrams")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, d1 long, d2 long, tokens array<long>"
    signed = scratch.keep(named.mapInArrow(tidy(_signature_batches(shingle, percent)), schema), "signed")

    linkable = signed.where("n > 0 and id is not null")
    classes = scratch.keep(linkable.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    # the joins below use a key of their own, so that a class with very many copies can be split
    key = F.struct(F.col("d1").bitwiseXOR(F.col("n")).alias("x"), F.col("d2").alias("y"))
    by_key = classes.select(key.alias("_key"), "rep")
    reps = linkable.where(F.size("tokens") > 0).select("id", "tokens", key.alias("k"))
    reps = reps.join(by_key, F.col("k") == F.col("_key")).where("id = rep")
    buckets = reps.select("id", F.explode("tokens").alias("bucket"))
    shared = buckets.groupBy("bucket").count().where("count > 1").select(F.col("bucket").alias("_open"))
    shared = scratch.keep(shared, "shared")
    members = possible(buckets, F.col("bucket"), bitmap_of(shared, F.col("_open")))
    scratch.release()
    members = scratch.keep(members.join(shared, F.col("bucket") == F.col("_open"), "left_semi").distinct(), "members")
    scratch.release()

    wanted = scratch.keep(members.select("id").distinct(), "wanted").withColumnRenamed("id", "_w")
    texts = possible(named.where("id is not null"), F.col("id"), bitmap_of(wanted, F.col("_w")))
    sets = texts.mapInArrow(tidy(_set_batches(shingle)), "id long, members array<long>")
    sets = scratch.keep(sets.join(wanted, F.col("id") == F.col("_w"), "left_semi"), "sets")
    scratch.release()
    reached = _components(scratch, members, sets, percent)

    keyed = signed.withColumn("k", F.when(F.col("n") > 0, key).otherwise(F.struct(F.col("id").alias("x"), F.lit(None).cast("long").alias("y"))))
    out = keyed.select("id", "n", "k").join(by_key, (F.col("k") == F.col("_key")) & F.col("id").isNotNull(), "left")
    out = out.join(reached, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
