"""Approximate nearest neighbours by an inverted file of product-quantised residuals, re-ranked exactly.

Vectors are scaled to length one, so the nearest by distance are the most alike by cosine.  A bounded sample gives coarse centres
(cells) and, for each slice of the residual, a codebook; every vector is then indexed: its cell, and one byte a slice.  A query
reads the codes of its ``probes`` nearest cells only, sums table entries, and the best of these are compared by their full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.operators.shared import Pieces, written
from citelake.operators.vectors import cosine

#: Rows that the model is fitted on at most, coarse cells, slices of a vector, entries of a codebook.
SAMPLE, CELLS, SLICES, ENTRIES = 20_000, 64, 16, 256
#: Cells that a query reads, and how many of their rows are compared in full for each wanted neighbour.  Vectors without
#: clusters need this many: they read 16 bytes of 63 % of the rows and 50 whole vectors; clustered ones need a fraction.
PROBES, RERANK = 40, 10
#: Queries that go out at a time.
BLOCK = 1024
#: Queries times rows that are compared at a time.
PAIRS = 1 << 21
_ROUNDS = 12


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    books: np.ndarray  # slices x entries x width of a slice

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T + (rows * rows).sum(axis=1)[:, None]


def _centres(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means from distinct rows, a fixed number of rounds; an empty centre takes the row that is farthest from its own."""
    pool = np.unique(rows, axis=0)
    centres = pool[np.random.default_rng(seed).permutation(len(pool))[:count]]
    for _ in range(_ROUNDS):
        apart = _distances(rows, centres)
        own = apart.argmin(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        far = np.argsort(-apart[np.arange(len(rows)), own], kind="stable")
        for centre, row in zip(np.flatnonzero(sizes == 0).tolist(), far.tolist(), strict=False):
            centres[centre] = rows[row]
    return centres


def fit(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS, slices: int = SLICES, sample: int = SAMPLE) -> Model:
    """Cells and codebooks of the ``sample`` rows with the least hashes of their ids (all of a smaller table).

    Vectors must have one width, which ``slices`` divides; null ones and such without length are not used.
    """
    named = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    picked = [r["v"] for r in named.orderBy("h", "i").limit(sample).collect()]
    if len({len(v) for v in picked}) > 1:
        raise ValueError("vectors of several widths")
    matrix = np.array(picked, np.float64).reshape(len(picked), -1)
    matrix = _unit(matrix[(matrix != 0).any(axis=1)])
    if not len(matrix) or matrix.shape[1] % slices:
        raise ValueError("no vectors, or slices do not divide their width")
    centres = _centres(matrix, cells, 0)
    rest = matrix - centres[_distances(matrix, centres).argmin(axis=1)]
    parts = rest.reshape(len(rest), slices, -1)
    books = [_centres(parts[:, k], ENTRIES, k + 1) for k in range(slices)]
    entries = min(map(len, books))
    return Model(centres, np.stack([b[:entries] for b in books]))


def _encoded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, model.width)
            rows = _unit(values)
            cell = _distances(rows, model.centres).argmin(axis=1)
            parts = (rows - model.centres[cell]).reshape(len(rows), len(model.books), -1)
            codes = np.stack([_distances(parts[:, k], model.books[k]).argmin(axis=1) for k in range(len(model.books))], 1).astype(np.uint8)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), packed], names=["id", "cell", "codes"])

    return run


def index(rows: DataFrame, model: Model, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, cell, codes`` of every row whose vector has the model's width and a length; write it, partitioned by ``cell``."""
    kind = rows.schema[id_col].dataType.simpleString()
    usable = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == model.width) & F.exists("v", lambda x: x != 0)
    )
    return usable.mapInArrow(_encoded(model), f"id {kind}, cell int, codes binary")


def _probed(model: Model, ids: list, vectors: np.ndarray, probes: int, keep: int):
    """A function over Arrow batches (id, cell, codes): each task's best rows for each query that reads their cells.

    A cell's rows are rebuilt from their codes and multiplied with all queries that read the cell; only what is no farther than a
    query's ``keep`` best so far is sorted.  Distances are rounded, so that equal codes are equally far.
    """
    queries = _unit(vectors)
    near = np.argsort(_distances(queries, model.centres), axis=1, kind="stable")[:, :probes]
    asking = {cell: np.flatnonzero((near == cell).any(axis=1)) for cell in np.unique(near).tolist()}
    rows = max(64, PAIRS // max(1, len(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = np.arange(len(model.books))[None, :]
        reach, q, apart, found = np.full(len(queries), np.inf), np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                cells = part.column(1).to_numpy()
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(cells), len(model.books))
                rebuilt = model.centres[cells] + model.books[slices, codes].reshape(len(cells), -1)
                lengths = (rebuilt * rebuilt).sum(axis=1)
                held = len(q)
                fresh_q, fresh_apart, fresh = [q], [apart], [np.arange(held)]
                for cell in np.unique(cells).tolist():
                    asked = asking.get(cell)
                    if asked is None:
                        continue
                    own = np.flatnonzero(cells == cell)
                    each = 1 + lengths[own][None, :] - 2 * queries[asked] @ rebuilt[own].T
                    one, other = np.nonzero(each <= reach[asked][:, None])
                    fresh_q.append(asked[one])
                    fresh_apart.append(np.round(each[one, other], 9))
                    fresh.append(held + own[other])
                q, apart, row = np.concatenate(fresh_q), np.concatenate(fresh_apart), np.concatenate(fresh)
                order = np.lexsort((row, apart, q))
                q, apart, row = q[order], apart[order], row[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                last = rank == keep - 1
                reach[q[last]] = apart[last] + 1e-9
                kept = rank < keep
                q, apart = q[kept], apart[kept]
                told = part.column(0) if found is None else pa.concat_arrays([found, part.column(0)])
                found = told.take(pa.array(row[kept]))
        if found is not None:
            asked_ids = pa.array(ids, found.type).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([asked_ids, found, pa.array(apart)], names=["query_id", "id", "apart"])

    return run


def search(
    indexed: DataFrame, rows: DataFrame, queries: DataFrame, model: Model, limit: int = 5, probes: int = PROBES, rerank: int = RERANK,
    id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """``query_id, id, score, rank``: for every row of ``queries`` the ``limit`` most alike that its cells hold, by full cosine (ties by id).

    Queries go out in blocks.  A row never finds one of its own id.  With ``probes`` of all cells and a ``rerank`` of all rows the result
    is that of :func:`citelake.operators.vectors.search_many`, which stays the exact way.
    """
    kind = indexed.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, apart double"
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == model.width) & F.exists("v", lambda x: x != 0))
    asked = written(asked, "asked")
    blocks = max(1, -(-asked.count() // block))
    keep = limit * rerank + 1
    best = Window.partitionBy("query_id").orderBy("apart", "id")
    pieces = Pieces(rows.sparkSession, "probed", schema)
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()  # about ``block`` rows
        if own:
            near = indexed.mapInArrow(_probed(model, [r["id"] for r in own], np.array([r["v"] for r in own]), probes, keep), schema)
            pieces.add(near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep).drop("_n"))
    pairs = pieces.table().where("query_id <> id").select("query_id", "id").distinct()
    full = rows.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    pairs = pairs.join(full, F.col("id") == F.col("_id")).join(asked.select(F.col("id").alias("_q"), F.col("v").alias("_qv")), F.col("query_id") == F.col("_q"))
    scored = pairs.select("query_id", "id", F.round(cosine(F.col("_qv"), F.col("_v")), 6).alias("score")).where("score is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def share_read(indexed: DataFrame, queries: DataFrame, model: Model, probes: int = PROBES, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """The share of indexed rows whose codes a query reads, over all queries."""
    sizes = np.zeros(len(model.centres))
    for cell, n in indexed.groupBy("cell").count().collect():  # one row a cell
        sizes[cell] = n
    read = index(queries, Model(model.centres, model.books), id_col, vector)
    near = np.argsort(_distances(model.centres, model.centres), axis=1, kind="stable")[:, :probes]
    cells = {r["cell"]: r["count"] for r in read.groupBy("cell").count().collect()}
    asked = sum(cells.values())
    return float(sum(sizes[near[c]].sum() * n for c, n in cells.items()) / max(1, asked) / max(1, sizes.sum()))
