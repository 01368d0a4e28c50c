from __future__ import annotations

import json

from citelake.operators import jobs
from citelake.schemas import EXTRACTION_RESULTS


def test_states_and_lists(spark):
    events = spark.createDataFrame(
        [("a", 1, "queued", 1.0), ("a", 2, "running", 2.0), ("a", 3, "succeeded", 5.0), ("a", 4, "failed", 6.0), ("b", 1, "queued", 3.0), ("b", 2, "noise", 4.0)],
        "job_id string, seq long, event string, at double",
    )
    got = {r["job_id"]: (r["status"], r["started_at"], r["finished_at"]) for r in jobs.states(events).collect()}
    assert got == {"a": ("succeeded", 2.0, 5.0), "b": ("queued", None, None)}
    rows = spark.createDataFrame([("a", 1.0, 2.0, 5.0, ["e"]), ("c", 9.0, None, None, [])], "job_id string, created_at double, started_at double, finished_at double, errors array<string>")
    assert [(r["job_id"], r["kind"]) for r in jobs.listed(rows.where("job_id = 'a'"), rows.where("job_id = 'c'")).collect()] == [("c", "agent"), ("a", "crawl")]
    assert jobs.listed(rows, rows, 0).count() == 1


def test_errors_are_told_once(spark):
    errors = spark.createDataFrame([("a", n, f"m{n}") for n in range(4)] + [("b", 0, "x")], "job_id string, seq long, message string")
    told = spark.createDataFrame([("a", 1)], "job_id string, upto long")
    assert [(r["job_id"], r["seq"]) for r in jobs.unpublished(errors, told).collect()] == [("a", 2), ("a", 3), ("b", 0)]


def test_prompts_are_asked_once(spark):
    prompts = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    first = jobs.to_ask(prompts, spark.createDataFrame([], "key string, reply string"), "x", "u", "m")
    assert first.count() == 2
    cache = first.where("prompt = 'p'").selectExpr("key", "'r' AS reply")
    assert [r["prompt"] for r in jobs.to_ask(prompts, cache, "x", "u", "m").collect()] == ["q"]
    assert jobs.to_ask(prompts, cache, "x", "u", "other").count() == 2


def test_results(spark):
    def row(n, entities, triples, data, cited):
        return (n, "j", f"u{n}", None, 200, entities, triples, [], "", json.dumps(data), cited, [], [], "m", None)

    rows = [
        row(1, [("Ada", "PERSON")], [("Ada", "knows", "Bob")], {"items": [{"n": 1}]}, {"/items/0/n": [("one", "u1")]}),
        row(2, [("Bob", "PERSON")], [], {"items": [{"n": 2}]}, {"/items/0/n": [("two", "u2")]}),
    ]
    found = jobs.results(spark.createDataFrame(rows, EXTRACTION_RESULTS), "j")
    merged = json.loads(jobs.structured_json(found["structured"]))
    assert merged["data"] == {"items": [{"n": 1}, {"n": 2}]} and merged["citations"]["/items/1/n"] == [{"quote": "two", "url": "u2"}]
    assert [(r["label"], r["type"]) for r in found["nodes"].orderBy("id").collect()] == [("Ada", "PERSON"), ("Bob", "PERSON")]
    assert found["edges"].first()["type"] == "knows" and not found["truncated"].first()["truncated"]
    assert json.loads(jobs.structured_json(jobs.results(spark.createDataFrame(rows, EXTRACTION_RESULTS), "other")["structured"]))["data"] == {}
