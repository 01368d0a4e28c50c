"""Merging rows in any grouping gives what merging the parts one after the other gives; quotes are found wherever they are."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citelake.functions.jsonx import escape, leaves
from citelake.functions.text import fold
from citelake.operators import merging, quotes, structured
from citelake.operators.shared import scratch, sweep, written

PARTS = "job int, seq int, data string, citations map<string,array<struct<quote:string,url:string>>>, unverified array<string>, schema_errors array<string>"


def one_after_another(parts: list[dict]) -> dict:
    """The rule as it is stated for parts in order: each is laid over what is there."""
    state: dict = {"data": None}
    cited: dict[str, list] = {}
    doubted: set[str] = set()
    for part in parts:
        home: dict[str, str] = {}  # where each leaf of the part belongs now
        weak = set(part["unverified"])

        def all_of(value, source, target, home=home):
            home.update({source + p: target + p for p, _ in leaves(value)})

        def lay(old, new, source, target, home=home, weak=weak):
            if old is None or old == "":
                all_of(new, source, target)
                return json.loads(json.dumps(new))
            if new is None or new == "":
                return old
            if isinstance(old, dict) and isinstance(new, dict):
                return old | {k: lay(old.get(k), v, f"{source}/{escape(k)}", f"{target}/{escape(k)}") for k, v in new.items()}
            if isinstance(old, list) and isinstance(new, list):
                known = [json.dumps(x, sort_keys=True) for x in old]
                for n, item in enumerate(new):
                    name = json.dumps(item, sort_keys=True)
                    if name not in known:
                        old, known = [*old, item], [*known, name]
                    all_of(item, f"{source}/{n}", f"{target}/{known.index(name)}")
                return old
            if isinstance(old, (dict, list)) or isinstance(new, (dict, list)):
                return old
            if old == new:
                home[source] = target
            elif target in doubted and source not in weak:
                doubted.discard(target)
                cited.pop(target, None)
                home[source] = target
                return new
            return old

        state["data"] = lay(state["data"], part["data"], "", "")
        for pointer, found in part["citations"].items():
            if pointer in home:
                held = cited.setdefault(home[pointer], [])
                held += [q for k, q in enumerate(found) if q not in held and q not in found[:k]]
        doubted |= {home[p] for p in weak if p in home and home[p] not in cited}
    errors = [e for part in parts for e in part["schema_errors"]]
    return {"data": {} if state["data"] is None else state["data"], "citations": cited, "unverified": sorted(doubted - set(cited)), "schema_errors": errors}


def some_value(rng: random.Random, depth: int):
    kind = rng.random()
    if depth and kind < 0.45:
        return {k: some_value(rng, depth - 1) for k in rng.sample(["a", "b", "c/d", "e~f"], rng.randint(0, 3))}
    if kind < 0.7:
        return [rng.choice([1, 2, "x", None, "", {"n": rng.randint(0, 2), "m": "y"}, {"m": "y", "n": 1}, [1]]) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, "", "u", "v", "w", 1, 1.0, True, 0, False, 2.5])


def some_part(rng: random.Random) -> dict:
    data = {k: some_value(rng, 2) for k in rng.sample(["t", "a", "items", "s", "z"], rng.randint(1, 5))} if rng.random() < 0.9 else some_value(rng, 1)
    where = [p for p, _ in leaves(data)]
    cited = {p: [{"quote": f"q{rng.randint(0, 3)}", "url": "u"} for _ in range(rng.randint(0, 3))] for p in where if rng.random() < 0.4}
    return {"data": data, "citations": cited | {"/nowhere": []}, "unverified": [p for p in where if rng.random() < 0.4], "schema_errors": ["e"] * rng.randint(0, 1)}


def rows_of(jobs: dict[int, list[dict]]) -> list[tuple]:
    return [(job, seq, json.dumps(p["data"]), p["citations"], p["unverified"], p["schema_errors"]) for job, parts in jobs.items() for seq, p in enumerate(parts)]


@pytest.fixture(scope="module")
def jobs():
    rng = random.Random(3)
    out = {job: [some_part(rng) for _ in range(rng.randint(1, 7))] for job in range(150)}
    for job in range(150, 220):  # one scalar that changes hands, again and again
        out[job] = [
            {"data": {"t": rng.choice("uvw")}, "citations": {"/t": [{"quote": str(n), "url": "u"}]} if rng.random() < 0.3 else {}, "unverified": ["/t"] * (rng.random() < 0.6), "schema_errors": []}
            for n in range(rng.randint(1, 25))
        ]
    return out


def test_rows_merge_as_parts_do(spark, jobs):
    parts = spark.createDataFrame(rows_of(jobs), PARTS).repartition(5)
    got = {r["job"]: r for r in merging.merge(parts, "job", "seq").collect()}
    assert set(got) == set(jobs)
    for job, parts_of in jobs.items():
        want, row = one_after_another(parts_of), got[job]
        found = {p: [q.asDict() for q in qs] for p, qs in row["citations"].items()}
        assert row["data"] == json.dumps(want["data"], ensure_ascii=False), job
        assert (found, row["unverified"], row["schema_errors"]) == (want["citations"], want["unverified"], want["schema_errors"]), job


def test_merged_leaves(spark, jobs):
    parts = spark.createDataFrame(rows_of(jobs), PARTS)
    got: dict[int, dict] = {}
    for r in merging.merged_leaves(parts, "job", "seq").collect():
        got.setdefault(r["job"], {})[r["pointer"]] = (json.loads(r["value"]), [q["quote"] for q in r["quotes"]], r["unverified"])
    for job, parts_of in jobs.items():
        want = one_after_another(parts_of)
        assert got.get(job, {}) == {p: (v, [q["quote"] for q in want["citations"].get(p, [])], p in want["unverified"]) for p, v in leaves(want["data"])}, job
    empty = spark.createDataFrame([], PARTS)
    assert merging.merged_leaves(empty, "job", "seq").count() == merging.merge(empty, "job", "seq").count() == 0
    nothing = merging.merge(spark.createDataFrame([(1, 0, None, None, None, None), (None, 0, '{"a": 1}', {}, [], [])], PARTS), "job", "seq")
    assert sorted((r["job"] or 0, r["data"]) for r in nothing.collect()) == [(0, '{"a": 1}'), (1, "{}")]


def test_quotes_are_found_everywhere(spark):
    rng = random.Random(2)
    pages = [(n, "".join(rng.choice("aB *\n") for _ in range(rng.randint(0, 60)))) for n in range(60)] + [(60, None), (61, "Die Straße — “ja”"), (62, "x" * 50_000 + "ab")]
    found = [(n, "".join(rng.choice("Ab ") for _ in range(rng.randint(1, 5)))) for n in range(40)] + [(40, None), (41, " * "), (42, 'strasse - "JA"'), (43, "aba"), (43, "aba")]
    tables = spark.createDataFrame(found, "q int, quote string"), spark.createDataFrame(pages, "p int, text string")
    want = []
    for q, quote in found:
        for p, text in pages:
            needle, page = fold(quote or ""), fold(text or "")
            want += [(q, p, at) for at in range(len(page)) if needle and page.startswith(needle, at)]
    for block in (1 << 20, 12):
        got = quotes.quote_hits(*tables, "q", "p", block_chars=block)
        assert sorted(map(tuple, got.collect())) == sorted(want), block
    none = spark.createDataFrame([], "q int, quote string")
    assert quotes.quote_hits(none, tables[1], "q", "p").count() == 0


PAGE = "# Plans\n\nThe **Pro** plan costs “$20” — per [month](/m).\n"


def test_every_leaf_is_cited_or_unverified(spark):
    replies = [
        {"data": {"plan": "Pro plan", "price": "$20", "n": 7, "none": None}, "citations": {"price": ['costs "$20" - per month', 'costs "$20" - per [month](x)', "invented"], "n": {"quote": "seven"}}},
        {"data": {"a/b": [{"c": "month"}, "pro"]}, "citations": {"data.a~1b": "x", "/a~1b/0/c": [{"text": "per month"}, 5, None, ["per month"]], "": "x"}},
        {"data": {}, "citations": ["Plans"]},
    ]
    rows = [("u", PAGE, json.dumps(r)) for r in replies] + [(None, None, json.dumps(replies[0])), ("u", PAGE, None), ("u", PAGE, "[1]")]
    got = structured.verify_replies(spark.createDataFrame(rows, "url string, page string, reply string")).collect()
    cited = [{p: [q["quote"] for q in qs] for p, qs in r["citations"].items()} for r in got]
    assert cited[0] == {"/plan": ["Pro plan"], "/price": ['costs "$20" - per month']} and got[0]["unverified"] == ["/n"]
    assert cited[1] == {"/a~1b/0/c": ["per month"]} and got[1]["unverified"] == ["/a~1b/1"]
    assert got[0]["citations"]["/plan"][0]["url"] == "u" and cited[2] == {}
    assert cited[3] == {} and got[3]["unverified"] == ["/plan", "/price", "/n"]
    assert [(r["data"], r["unverified"]) for r in got[4:]] == [("{}", []), ("{}", [])]


def test_scratch_goes_with_the_session(spark, tmp_path):
    path = scratch(spark, "x").removeprefix("file://")
    Path(path).mkdir(parents=True)
    kept = written(spark.range(3), "y")
    folders = {str(Path(f.removeprefix("file://")).parents[0]) for f in kept.inputFiles()}
    assert kept.count() == 3 and all(Path(f).exists() for f in folders)
    sweep(spark)
    assert not Path(path).exists() and not any(Path(f).exists() for f in folders)
    script = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "from citelake.operators.shared import written\n"
        "assert written(s.range(3), 'z').count() == 3\n"
        "s.stop()\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", script], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=120)
    assert not [p for p in Path(tmp_path).rglob("*") if p.is_file()]


def test_streamed_rows_merge_as_parts_do(spark, jobs, tmp_path):
    from citelake.streaming.jobs import part_rows

    some = {job: parts for job, parts in jobs.items() if job % 10 == 0}
    parts = spark.createDataFrame(rows_of(some), PARTS).withColumnRenamed("job", "job_id")
    for turn in (1, 0):  # later parts come first
        parts.where(F.col("seq") % 2 == turn).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = part_rows(spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    _, pointers = merging.merged_values(spark.read.parquet(str(tmp_path / "rows")))
    got: dict[int, dict] = {}
    for r in pointers.collect():
        got.setdefault(r["key"], {})[r["pointer"]] = json.loads(r["value"])
    for job, parts_of in some.items():
        assert got.get(job, {}) == dict(leaves(one_after_another(parts_of)["data"]))
