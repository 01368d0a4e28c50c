"""Cosine search over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.operators.shared import written

#: Queries that are compared with all rows at a time, and rows of a task that they are multiplied with at a time.
BLOCK, ROWS = 4096, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length or widths differ."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def search(
    rows: DataFrame, query: Sequence[float], limit: int = 5, threshold: float | None = None, id_col: str = "vec_id", vector: str = "embedding", **equal
) -> DataFrame:
    """The ``limit`` rows most like ``query`` (ties by id), with their ``score``; ``equal`` filters columns first.

    The query is a literal, so this is a scan and a top-k: every task keeps ``limit`` rows.
    """
    for column, value in equal.items():
        if value is not None and str(value).strip():
            rows = rows.where(F.col(column) == value)
    given = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), given), 6)).where(F.col("score").isNotNull())
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def search_many(rows: DataFrame, queries: DataFrame, limit: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, id, score, rank`` for every row of ``queries`` against all others of ``rows`` (ties by id).

    Queries are taken in blocks of about ``block`` rows, one after the other: a block is a matrix that every task
    multiplies with its rows, batch by batch, keeping the best ``limit`` of each query; only those are shuffled, and each
    block's result is written before the next block begins.  Vectors without a length, and pairs of different widths,
    have no score.  Repeated ids are rows of their own; a row never finds one of its own id.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    found = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toPandas()
        best = found.mapInArrow(_multiplied(list(own["id"]), list(own["v"]), limit), f"query_id {kind}, id {kind}, score double")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")
        best = written(best, f"neighbours-{k}") if blocks > 1 else best
        out = best if out is None else out.unionByName(best)
    return out


def _multiplied(ids: list, vectors: list, limit: int):
    """A function over Arrow batches (id, v): each task's best rows for each query."""
    widths: dict[int, list[int]] = {}
    for n, v in enumerate(vectors):
        if len(v):
            widths.setdefault(len(v), []).append(n)

    def unit(matrix: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, lengths, out=np.full_like(matrix, np.nan), where=lengths > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {width: (np.array(own), unit(np.array([vectors[n] for n in own], np.float64))) for width, own in widths.items()}
        place: dict = {}
        for n, i in enumerate(ids):
            place.setdefault(i, []).append(n)
        best = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                part_ids, part_vectors = part.column(0).to_pylist(), part.column(1)
                sizes = pc.list_value_length(part_vectors).to_numpy(zero_copy_only=False)
                for width, (own, matrix) in asked.items():
                    rows = np.flatnonzero(sizes == width)
                    if not len(rows):
                        continue
                    values = part_vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    scores = np.nan_to_num(matrix @ unit(values).T, nan=-np.inf)
                    at = {n: k for k, n in enumerate(own.tolist())}
                    for k, r in enumerate(rows.tolist()):
                        for n in place.get(part_ids[r], ()):
                            if n in at:
                                scores[at[n], k] = -np.inf
                    kth = np.partition(scores, -min(limit, len(rows)), axis=1)[:, -min(limit, len(rows))]
                    q, k = np.nonzero((scores >= kth[:, None] - 2e-6) & np.isfinite(scores))
                    fresh = pd.DataFrame({"q": own[q], "id": pd.Series([part_ids[r] for r in rows[k].tolist()], dtype="object"), "score": np.round(scores[q, k], 6)})
                    best = pd.concat([best, fresh]) if len(best) else fresh
                    best = best.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(limit)
        if kind is not None and len(best):
            asked_ids = pa.array([ids[n] for n in best["q"].tolist()], kind)
            yield pa.RecordBatch.from_arrays([asked_ids, pa.array(best["id"].tolist(), kind), pa.array(best["score"].to_numpy(), pa.float64())], names=["query_id", "id", "score"])

    return run
