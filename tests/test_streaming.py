"""Streaming forms give what the batch forms give on the same rows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from citelake.functions.html import jaccard, shingle_set
from citelake.sources.keyed import KeyedTable
from citelake.streaming import jobs, stateful


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def source(spark, frame, path, files=2):
    """``frame`` as a stream of ``files`` files, in order of ``seq``."""
    half = frame.count() // files + 1
    for n in range(files):
        frame.where((F.col("seq") >= n * half) & (F.col("seq") < (n + 1) * half)).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("seq", F.col("event_id"))
    got = run(jobs.event_counts(source(spark, events, tmp_path / "e"), "1 day", "1 day"), "windows", "update")
    last = {(r["start"], r["event_type"]): r["n"] for r in got}
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("s"), "event_type").count().collect()
    assert last == {(r["s"], r["event_type"]): r["count"] for r in want}


def one_by_one(texts, capacity, threshold=0.85):
    """The rule for pages in order: an ordered memory of kept pages, named by how they begin."""
    held, out = {}, []
    for text in texts:
        own = shingle_set(text) if text and len(text) >= 40 else frozenset()
        out.append(not own or all(jaccard(own, other) < threshold for other in held.values()))
        if own and out[-1]:
            held[text[:256]] = own
            if len(held) > capacity:
                del held[next(iter(held))]
    return out


def some_texts(rng, count):
    """Texts of which many are copies of others, nearly, after a while, or with the same beginning."""
    vocabulary = [f"w{n}" for n in range(40)]
    out = [None, "", "short", "a b c d"]
    while len(out) < count:
        if len(out) > 5 and rng.random() < 0.7:
            words = (out[-rng.choice([1, 1, 2, 4, 12])] if len(out) > 12 else out[-1] or "").split() or ["a", "b"]
            if rng.random() < 0.3:
                words = words[:80] + rng.choices(vocabulary, k=rng.randint(5, 60))
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randint(3, 150))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("capacity", [1, 3, 10, 2000])
def test_deduplication_against_the_newest(spark, tmp_path, capacity):
    rng = random.Random(capacity)
    jobs_of = {job: some_texts(rng, 60) for job in ("a", "b", "c")}
    rows = [(job, n, text) for job, texts in jobs_of.items() for n, text in enumerate(texts)]
    want = {(job, n): kept for job, texts in jobs_of.items() for n, kept in enumerate(one_by_one(texts, capacity))}
    assert 5 < sum(not kept for kept in want.values()) < 150
    pages = spark.createDataFrame(rows, "job_id string, seq long, text string")
    whole = {(r["job_id"], r["seq"]): r["kept"] for r in stateful.deduplicate(pages.repartition(4), capacity=capacity).collect()}
    assert whole == want
    if capacity == 3:
        for n in range(3):
            pages.where((F.col("seq") % 60 >= n * 20) & (F.col("seq") % 60 < n * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        stream = stateful.deduplicate(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p")), capacity=capacity)
        for again in (False, True):  # a second start goes on from the checkpoint
            if again:
                pages.where("seq < 10").withColumn("seq", F.col("seq") + 60).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(240)
        got = {(r["job_id"], r["seq"]): r["kept"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {(job, n): kept for job, texts in jobs_of.items() for n, kept in enumerate(one_by_one(texts + texts[:10], capacity))}
        assert stateful.deduplicate(pages.limit(0)).count() == 0


def test_queue_states(spark, tmp_path):
    data = [("a", 0, "add"), ("b", 1, "add"), ("a", 2, "take"), ("b", 3, "take"), ("a", 4, "complete")] + [("b", 5 + n, "fail") for n in range(4)]
    events = spark.createDataFrame(data, "url string, seq long, event string")
    stream = stateful.request_queue(source(spark, events, tmp_path / "q"))
    # leases are timeouts, so the query runs on; it is stopped once the states are as they must be
    query = stream.writeStream.format("memory").queryName("queue").outputMode("update").start()
    last, until = {}, time.time() + 60
    while time.time() < until and last != {"a": ("completed", 0), "b": ("dropped", 3)}:
        time.sleep(0.5)
        last = {r["url"]: (r["status"], r["retries"]) for r in spark.table("queue").collect()}
    query.stop()
    assert last == {"a": ("completed", 0), "b": ("dropped", 3)}


def test_a_lease_ends(spark, tmp_path):
    events = spark.createDataFrame([("a", 0, "add"), ("a", 1, "take"), ("b", 2, "add"), ("b", 3, "take"), ("b", 4, "complete")], "url string, seq long, event string")
    stream = stateful.request_queue(source(spark, events, tmp_path / "q", files=1), lease_seconds=1)
    query = stream.writeStream.format("memory").queryName("leases").outputMode("update").trigger(processingTime="500 milliseconds").start()
    told, until = [], time.time() + 90
    while time.time() < until and ("a", "queued") not in told:
        time.sleep(0.5)
        told = [(r["url"], r["status"]) for r in spark.table("leases").orderBy("at").collect()]
    query.stop()
    assert sorted(told) == [("a", "locked"), ("a", "queued"), ("b", "completed")]


def test_publish_keeps_one_row_per_key(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/out", "k string, seq long, v long", ["k"], ["seq"], buckets=4)

    def publish(rows, name, checkpoint):
        stream = source(spark, spark.createDataFrame(rows, "seq long, k string, v long"), tmp_path / name)
        query = jobs.publish(stream, table, str(tmp_path / checkpoint), most=1).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r["k"], r["v"]) for r in table.read().collect())

    assert publish([(n, f"k{n % 3}", n * 10) for n in range(9)], "s", "cp") == [("k0", 60), ("k1", 70), ("k2", 80)]
    version = table.versions()[-1]
    table.upsert(spark.createDataFrame([("k9", 0, 0)], "k string, seq long, v long"), stream=next(iter(table.manifest().done)), batch=0)
    assert table.versions()[-1] == version  # a batch that is told again
    # a new checkpoint begins at batch 0 and loses nothing
    assert publish([(0, "k4", 0), (1, "k0", 1), (2, "k3", 3)], "s2", "cp2") == [("k0", 60), ("k1", 70), ("k2", 80), ("k3", 3), ("k4", 0)]


def test_progress(spark):
    events = spark.createDataFrame([("j", 0), ("j", 1), ("k", 2)], "job_id string, seq long")
    assert [r["seq"] for r in jobs.progress(events, "j", 0).collect()] == [1]


def test_captured_calls(spark, tmp_path):
    rows = [(0, "http://s/a", "response", None), (1, "http://s/a", "request", None), (2, "http://s/b", "request", None), (3, "http://s/a", "response", "x"), (4, "http://s/a", "response", "y"), (5, "http://s/i.png", "response", "z")]
    events = spark.createDataFrame([(u, n, k, "application/json", b) for n, u, k, b in rows], "url string, seq long, kind string, content_type string, body string")
    got = run(jobs.captured_calls(source(spark, events, tmp_path / "c", files=3)), "captured", "append")
    assert sorted((r["seq"], r["request_seq"], r["body"]) for r in got) == [(0, None, None), (3, 1, "x"), (4, 1, "y")]


def test_entries_of_an_empty_map_are_not_looked_up():
    """What comes and goes before a new map is written costs no call to the store; a stored entry is removed with one."""

    class Store(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            self.calls += 1
            return key in self

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            self.calls += 1
            del self[key]

    store = Store()
    entries = stateful.Entries(store, True)
    for n in range(1000):
        assert entries.get(n) is None
        entries.put(n, (n,))
        if n >= 5:
            entries.put(n - 5, None)
    entries.flush()
    assert dict(store) == {(n,): (n,) for n in range(995, 1000)} and store.calls == 5
    entries.put(999, None)
    entries.put(1, None)
    assert entries.get(998) == (998,)
    entries.flush()
    assert dict(store) == {(n,): (n,) for n in range(995, 999)}
