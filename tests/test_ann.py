"""Neighbours out of the index against the exact ones."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from citelake.operators import ann, vectors

KIND = "vec_id long, embedding array<float>"


def pairs(found):
    return {(r["query_id"], r["id"]) for r in found.collect()}


def test_recall_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0")
    model = ann.fit(rows)
    indexed = ann.index(rows, model).cache()
    assert indexed.count() == rows.count()
    exact, got = pairs(vectors.search_many(rows, queries)), pairs(ann.search(indexed, rows, queries, model, block=64))
    share = ann.share_read(indexed, queries, model)
    print("recall", len(exact & got) / len(exact), "share read", share)
    assert len(exact & got) >= 0.9 * len(exact) and share < 0.7


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    data = [(n, (centres[n % 6] + rng.normal(size=8) * 0.3).tolist()) for n in range(300)]
    data += [(300, data[0][1]), (301, [0.0] * 8), (302, None), (303, [1.0]), (None, data[1][1])]
    rows = spark.createDataFrame(data, KIND)
    usable = spark.createDataFrame(data[:301], KIND)
    model = ann.fit(usable, cells=7, slices=4)
    indexed = ann.index(rows, model)
    assert indexed.count() == 301
    queries = rows.where("vec_id % 10 = 0 or vec_id > 300")
    exact = {tuple(r) for r in vectors.search_many(usable, usable.where("vec_id % 10 = 0")).collect()}
    assert {tuple(r) for r in ann.search(indexed, rows, queries, model, probes=7, rerank=100).collect()} == exact
    assert ann.search(indexed, rows, queries.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        ann.fit(rows, slices=4)
    with pytest.raises(ValueError):
        ann.fit(rows.limit(0))


def test_probing_multiplies_cells_and_not_row_by_row(spark):
    """A task's best rows are those of all distances to the codes, ties by place; 1,000 queries over 20,000 rows take a moment."""
    rng = np.random.default_rng(2)
    vectors_ = np.round(rng.normal(size=(20_000, 16)), 1)
    vectors_[5_000:5_200] = vectors_[7]
    model = ann.Model(ann._unit(rng.normal(size=(12, 16))), rng.normal(size=(4, 32, 4)) * 0.2)
    rows = ann._encoded(model)(iter([pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(list(vectors_), pa.list_(pa.float64()))], names=["id", "v"])]))
    rows = list(rows)[0]
    asked = vectors_[:1_000]
    began = time.process_time()
    got = next(ann._probed(model, list(range(1_000)), asked, 8, 11)(iter([rows.slice(first, 500) for first in range(0, 20_000, 500)]))).to_pandas()
    assert time.process_time() - began < 8  # a table walk for each query and cell of a batch took 24 seconds
    cells, codes = rows.column(1).to_numpy(), np.array([list(c) for c in rows.column(2).to_pylist()])
    rebuilt = model.centres[cells] + model.books[np.arange(4)[None, :], codes].reshape(-1, 16)
    for q in (0, 7, 999):
        unit = asked[q] / np.linalg.norm(asked[q])
        read = np.isin(cells, np.argsort(((model.centres - unit) ** 2).sum(axis=1))[:8])
        apart = np.where(read, np.round(((rebuilt - unit) ** 2).sum(axis=1), 9), np.inf)
        own = got[got.query_id == q]
        assert own.id.tolist() == np.argsort(apart, kind="stable")[:11].tolist() and np.allclose(own.apart, np.sort(apart)[:11])
