"""Near-duplicate pages: similar pairs of shingle sets, and the greedy choice of which to keep.

A page is compared with the pages before it that were kept, so the choice depends on order and is not one page per
connected group.  Texts of fewer than 40 characters or without a shingle are always kept and never compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.hashed_sets import digests, hashed_sets
from citelake.functions.text import SHINGLE, bound, words
from citelake.operators.shared import written

PERCENT = 85
LEAST_CHARS = 40
#: Counts of the sketch that tells common members from rare ones.
SLOTS = 1 << 16
#: Pairs whose texts are hashed at a time.
PAIRS = 256


def shingle_members(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of the text's distinct shingles, in order; null where it has none."""

    def hashed(tokens: Column) -> Column:
        n = F.size(tokens)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))
        return F.when(n >= k, F.array_sort(F.array_distinct(each)))

    return bound(words(F.lower(text)), hashed)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` of the comparable texts, lower-cased.  Their sets are hashed anew wherever they are needed and never
    stored: a set is larger than its text."""
    return docs.where(F.length(text_col) >= LEAST_CHARS).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))


def _counted(k: int):
    """A function over Arrow batches (text): how often each slot of the sketch occurs in the task's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, members, _ in hashed_sets(batch.column(0), k):
                total += np.bincount((members & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        told = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(total[told])], names=["slot", "count"])

    return run


def _digested(k: int, frequency: np.ndarray | None = None, percent: int = PERCENT):
    """A function over Arrow batches (id, text): ``id, n, x, y``, where equal sets have equal n, x, y, and with a ``frequency``
    ``head``, the set's least frequent members in order, as many as no partner can avoid.  Texts without a shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, members, begins in hashed_sets(batch.column(1), k):
                own = np.flatnonzero(np.diff(begins))
                sizes = np.diff(begins)[own]
                columns = [batch.column(0).slice(first, end - first).take(pa.array(own)), pa.array(sizes), *(pa.array(x[own].view(np.int64)) for x in digests(members, begins))]
                if frequency is not None:
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    order = np.lexsort((members, frequency[(members & np.uint64(len(frequency) - 1)).astype(np.int64)], row))
                    wanted = sizes - -(-sizes * percent // 100) + 1
                    kept = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < wanted[row]
                    where = np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(where), pa.array(members[order][kept].view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "x", "y", "head"][: len(columns)])

    return run


def _compared(k: int, percent: int):
    """A function over Arrow batches (a, b, one text, the other): the similar pairs with ``shared, total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAIRS):
                part = batch.slice(first, PAIRS)
                sides = []
                for column in (2, 3):
                    found = list(hashed_sets(part.column(column), k))
                    sizes = np.concatenate([np.diff(begins) for *_, begins in found])
                    sides.append((np.concatenate([members for _, _, members, _ in found]), np.repeat(np.arange(part.num_rows), sizes), sizes))
                members, row = np.concatenate([sides[0][0], sides[1][0]]), np.concatenate([sides[0][1], sides[1][1]])
                order = np.lexsort((members, row))
                members, row = members[order], row[order]
                shared = np.bincount(row[1:][(members[1:] == members[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                total = sides[0][2] + sides[1][2] - shared
                columns = [part.column(0), part.column(1), pa.array(shared.astype(np.int32)), pa.array(total.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "total"]).filter(pa.array(shared * 100 >= total * percent))

    return run


def similar_pairs(sets: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """``a, b, shared, total`` (a < b) of the representatives whose sets have a Jaccard similarity of ``percent`` or more.

    Representatives are the smallest ids of equal sets.  Members are ranked by how often their slot of a sketch of
    ``SLOTS`` counts occurs, over all texts, and each set is indexed by the rarest of its members, as many as a partner of
    that similarity cannot avoid all of; partners of other sizes are left out, and so are members that stand too late in
    both indexes to be the first that the sets share.  So common members make no pairs and only the index is shuffled;
    what is left is compared in full, by the texts.  The result is exact, whatever the counts are.
    """
    counted = sets.select("text").mapInArrow(_counted(k), "slot long, count long").groupBy("slot").agg(F.sum("count")).collect()  # SLOTS rows at most
    frequency = np.zeros(SLOTS, np.int64)
    for slot, count in counted:
        frequency[slot] = count
    kind = sets.schema["id"].dataType.simpleString()
    told = sets.select("id", "text").mapInArrow(_digested(k, frequency, percent), f"id {kind}, n long, x long, y long, head array<long>")
    heads = written(told.groupBy("n", "x", "y").agg(F.min("id").alias("id"), F.first("head").alias("head")).select("id", "n", "head"), "heads")

    def side(end: str) -> DataFrame:
        """Both sides of the join rename every column, so that they are one shuffle."""
        each = heads.select("id", "n", F.posexplode("head").alias("at", "m"))
        return each.select(F.col("id").alias(f"id{end}"), (F.col("n") - F.col("at")).alias(f"left{end}"), F.col("n").alias(f"n{end}"), F.col("m").alias(f"m{end}"))

    size_fits = (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
    in_reach = F.least("left1", "left2") * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    found = side("1").join(side("2"), (F.col("m1") == F.col("m2")) & (F.col("id1") < F.col("id2")) & size_fits & in_reach)
    found = written(found.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct(), "candidates")
    wanted = found.select(F.col("a").alias("_id")).union(found.select("b")).distinct()
    texts = sets.join(wanted, F.col("id") == F.col("_id"), "left_semi")  # other texts are not dealt out if the wanted ids can be broadcast
    one, two = texts.select(F.col("id").alias("_a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("_b"), F.col("text").alias("tb"))
    both = found.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb")
    return both.mapInArrow(_compared(k, percent), f"a {kind}, b {kind}, shared int, total int")


def greedy_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """``id, kept``: whether each text, in order of id, is no near copy of a kept one before it.

    A text whose set an earlier one has is never kept: either that one is, or what it is a copy of is.  Among the
    representatives, a round keeps those with no undecided or kept neighbour before them and drops the later
    neighbours of kept ones; there are as many rounds as the longest chain of decisions.
    """
    sets = shingle_sets(docs, id_col, text_col)
    edges = written(similar_pairs(sets, percent, k).select("a", "b"), "edges")
    kept = dropped = None
    undecided = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "undecided")
    while undecided.take(1):
        open_edges = edges.join(undecided.select(F.col("id").alias("a")), "a", "left_semi")
        now = undecided.join(open_edges.select(F.col("b").alias("id")), "id", "left_anti")
        now = written(now, "kept")
        gone = edges.join(now.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = written(gone, "dropped")
        kept = now if kept is None else kept.union(now)
        dropped = gone if dropped is None else dropped.union(gone)
        undecided = written(undecided.join(now.union(gone), "id", "left_anti"), "undecided")
    told = sets.mapInArrow(_digested(k), f"id {sets.schema['id'].dataType.simpleString()}, n long, x long, y long")
    first = told.groupBy("n", "x", "y").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = told.join(first, ["n", "x", "y"]).where("id <> first").select("id")
    lost = copies if dropped is None else copies.union(dropped)
    lost = lost.distinct().select(F.col("id").alias("_lost"))
    return docs.select(F.col(id_col).alias("id")).join(lost, F.col("id") == F.col("_lost"), "left").select(F.col("id").alias(id_col), F.col("_lost").isNull().alias("kept"))


def exact_keep(docs: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each distinct text by ``order``, all columns kept; null counts as the empty text.

    Rows without an order value come last, and of rows that share the first one the one with the least hash of its
    columns stays, so exactly one row remains of each text.  Column names that begin with ``_exact_`` are the operator's.
    """
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), F.xxhash64(*hashable).alias("hash"))
    keyed = docs.withColumn("_exact_digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withColumn("_exact_place", place)
    first = keyed.groupBy(F.col("_exact_digest").alias("_exact_d")).agg(F.min("_exact_place").alias("_exact_first"))
    kept = keyed.join(first, (F.col("_exact_digest") == F.col("_exact_d")) & F.col("_exact_place").eqNullSafe(F.col("_exact_first")))
    return kept.dropDuplicates(["_exact_digest"]).select(docs.columns)
