"""Page fetches as a data source, and deliveries of events to subscribers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citelake.sources import snapshots
from citelake.streaming import subscriptions as subs

STORED = "url string, status int, html string, error string"


def fetched(spark, folder, number, rows):
    spark.createDataFrame(rows, STORED).repartition(2).write.parquet(f"{folder}/{number}")


def test_page_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/fetched"
    snapshots.register(spark)
    load = lambda: spark.read.format("page_snapshots").option("path", folder).load()
    assert load().count() == 0
    fetched(spark, folder, 0, [("http://a", 200, "<title> A &amp; B </title><p>x</p>", None), ("http://b", None, "half a page", "timeout"), ("http://c", 404, "<p>no</p>", None)])
    fetched(spark, folder, 1, [("http://a", 200, "<title>A2</title>", None), ("http://d", 200, None, None)])
    (tmp_path / "fetched" / "2").mkdir()  # a round that is not complete
    want = {
        ("http://a", 0, 200, "A & B", "<title> A &amp; B </title><p>x</p>", None), ("http://b", 0, None, None, None, "timeout"), ("http://c", 0, 404, "", "<p>no</p>", None),
        ("http://a", 1, 200, "A2", "<title>A2</title>", None), ("http://d", 1, 200, None, None, None),
    }
    assert {tuple(r) for r in load().collect()} == want
    some = load().where("url = 'http://a' and round = 1")
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[:2] == ("http://a", 1)}
    assert load().where("status = 404").count() == 1 and load().where("status = 200 and url = 'http://d'").count() == 1

    def run():
        stream = spark.readStream.format("page_snapshots").option("path", folder).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    assert run() == sorted(want, key=str)
    fetched(spark, folder, 3, [("http://e", 200, "<p>e</p>", None)])
    assert run() == sorted(want | {("http://e", 3, 200, "", "<p>e</p>", None)}, key=str)  # each row once
    with pytest.raises(Exception, match="path"):
        spark.read.format("page_snapshots").load().count()


def test_events_reach_subscribers_once_and_in_order(spark, tmp_path):
    rng = random.Random(5)
    jobs = {"a": 30, "b": 12, "c": 55}
    log = {job: [(job, n, "page" if n < size - 1 else "done", f"{job}{n}") for n in range(size)] for job, size in jobs.items()}
    kind = "job_id string, seq long, event string, data string"
    table = subs.subscriptions(spark, f"file://{tmp_path}/subs", buckets=2)
    told: dict[tuple, list] = {}
    upto = dict.fromkeys(jobs, 0)
    joins = {0: [("x", "a"), ("x", "c"), ("y", "b")], 2: [("z", "a"), ("y", "c")], 5: [("late", "b")]}
    for turn in range(7):
        for job, size in jobs.items():
            upto[job] = size if turn == 5 else min(size, upto[job] + rng.randint(1, 9)) if job != "c" or turn < 3 else upto[job]
        events = spark.createDataFrame([e for job in jobs for e in log[job][: upto[job]]], kind)
        if turn in joins:
            subs.subscribe(table, spark.createDataFrame(joins[turn], "subscriber string, job_id string"), turn)
        if turn == 4:
            continue  # nobody is connected
        for r in subs.deliver(events, table, turn, backlog=40).orderBy("subscriber", "job_id", "place").collect():
            told.setdefault((r["subscriber"], r["job_id"]), []).append((r["event"], r["seq"], r["data"]))
    assert subs.deliver(events, table, 6).count() == 0 and subs.deliver(events, table, 7).count() == 0  # all are done or dropped
    for (who, job), got in told.items():
        first = got[0]
        assert first[0] == "snapshot" and first[2] == f"{job}{first[1]}"
        if got[-1][0] == "dropped":
            assert (who, job) in (("x", "c"), ("y", "c")) and got[-1][2].endswith("events behind")
            continue
        assert [(n, d) for e, n, d in got[1:] if e == "page"] == [(n, f"{job}{n}") for n in range(first[1] + 1, jobs[job] - 1)]
        assert [e for e, _, _ in got].count("done") == 1 and got[-1][0] == "done"
    assert set(told) == {pair for pairs in joins.values() for pair in pairs}
    states = {(r["subscriber"], r["job_id"]): r["state"] for r in table.read().collect()}
    assert states[("late", "b")] == "done" and {states[p] for p in told} <= {"done", "dropped"}
    assert table.read().where(F.col("state") == "open").count() == 0


def test_titles_of_long_pages_with_failures_between(tmp_path):
    """Rows of failed fetches in a batch that does not begin where its column does; a title that is cut within a reference."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pages = [f"<title>é{'ü' * (n % 50)}{n} &amp;&amp</title><p>{'ñ' * 999}</p>" for n in range(1000)]
    errors = ["timeout" if n % 7 == 0 else None for n in range(1000)]
    stored = {"url": [str(n) for n in range(1000)], "status": pa.array([200] * 1000, pa.int32()), "html": pages, "error": pa.array(errors, pa.string())}
    pq.write_table(pa.table(stored), tmp_path / "x.parquet")
    for loose, end in ((True, "&&"), (False, "&&amp")):
        batches = snapshots.read_file(f"file://{tmp_path}", snapshots.File(str(tmp_path / "x.parquet"), 0), {}, loose)
        got = [(r["title"], r["html"], r["error"]) for b in batches for r in b.to_pylist()]
        assert got == [(None, None, "timeout") if n % 7 == 0 else (f"é{'ü' * (n % 50)}{n} {end}", pages[n], None) for n in range(1000)]
