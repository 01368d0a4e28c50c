"""A keyed table against a dictionary: changes, deletions, versions, merging, writers that meet."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from citelake.sources.keyed import KeyedTable

SCHEMA = "k long, at long, v string"


def rows_of(table, version=None):
    return {r["k"]: (r["at"], r["v"]) for r in table.read(version).collect()}


def files_of(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_changes_against_a_dictionary(spark, tmp_path):
    rng = random.Random(6)
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=8)
    assert table.read().count() == 0
    held: dict = {}
    states = {0: {}}
    for turn in range(1, 10):
        gone = turn % 4 == 0
        change = [(rng.randint(0, 30), rng.randint(0, 50), f"v{turn}-{n}") for n in range(rng.randint(1, 12))]
        change = list({k: (k, at, v) for k, at, v in sorted(change)}.values())
        frame = spark.createDataFrame(change, SCHEMA)
        version = table.delete(frame) if gone else table.upsert(frame)
        for k, at, v in change:
            if k not in held or held[k][0] <= at:
                held[k] = (at, None if gone else v)
        states[version] = {k: x for k, x in held.items() if x[1] is not None}
        if turn in (5, 9):
            before = table.versions()[-1]
            opened = table.read()
            assert table.compact(most=1) == before + 1
            assert {r["k"]: (r["at"], r["v"]) for r in opened.collect()} == states[before]
            # what a deletion kept out stays out only as long as its row is kept: later rows alone decide afterwards
            held = dict(states[before])
            states[before + 1] = dict(held)
    for version, want in states.items():
        assert rows_of(table, version) == want, version
    assert table.vacuum(keep=1) > 0 and rows_of(table) == states[max(states)] and table.versions() == [max(states)]


def test_a_change_writes_its_own_buckets_only(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=16)
    table.upsert(spark.createDataFrame([(k, 0, "x") for k in range(500)], SCHEMA))
    before = files_of(tmp_path)
    assert len(before) == 16
    table.upsert(spark.createDataFrame([(3, 1, "y"), (3, 2, "z"), (4, 1, "y"), (None, 1, "n")], SCHEMA))
    new = files_of(tmp_path) - before
    assert len(new) <= 3 and before <= files_of(tmp_path)
    got = rows_of(table)
    assert (got[3], got[4], got[5], got[None], len(got)) == ((2, "z"), (1, "y"), (0, "x"), (1, "n"), 501)
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"])


def test_writers_that_meet_both_count(spark, tmp_path, monkeypatch):
    one = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=2)
    other = KeyedTable(spark, f"file://{tmp_path}/t")
    write = KeyedTable._write

    def overtaken(self, rows, manifest, number):
        if self is one and not hasattr(one, "met"):
            one.met = True
            other.upsert(spark.createDataFrame([(1, 5, "other"), (2, 5, "other")], SCHEMA))
        return write(self, rows, manifest, number)

    monkeypatch.setattr(KeyedTable, "_write", overtaken)
    one.upsert(spark.createDataFrame([(1, 6, "one"), (2, 4, "one"), (3, 0, "one")], SCHEMA))
    assert rows_of(other) == {1: (6, "one"), 2: (5, "other"), 3: (0, "one")}
    del one.met
    assert one.compact(most=0) and rows_of(one) == rows_of(other, 3) | {1: (6, "one"), 2: (5, "other")}
