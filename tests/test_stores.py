"""Stored pages, sessions, vectors, extraction of whole pages, files and the command line."""

import json

import pytest

from citelake import providers
from citelake.__main__ import main
from citelake.functions import screens
from citelake.operators import apis, embedding, graph, jobs, structured
from citelake.schemas import EXTRACTION_RESULTS
from citelake.sources import catalogue, upserts
from pyspark.sql import functions as F


def test_page_upsert_keeps_ids(spark):
    stored = spark.createDataFrame([(3, "a", "A", 1), (7, "b", "B", 1)], "id long, url_hash string, title string, crawled_at long")
    incoming = spark.createDataFrame([("b", "B2", 5), ("b", "B1", 4), ("d", "D", 6), ("c", None, 5), (None, "x", 9)], "url_hash string, title string, crawled_at long")
    got = sorted((r["id"], r["url_hash"], r["title"], r["crawled_at"]) for r in upserts.upsert_pages(stored, incoming).collect())
    assert got == [(3, "a", "A", 1), (7, "b", "B2", 5), (8, "c", None, 5), (9, "d", "D", 6)]
    assert upserts.upsert_pages(stored.limit(0), incoming).count() == 3 and upserts.upsert_pages(stored, incoming.limit(0)).count() == 2


def test_session_updates(spark):
    kind = "session_id string, seq long, cookies string, headers map<string,string>"
    sessions = spark.createDataFrame([("a", "p", "old", {"h": "1"}), ("b", "p", "old", None)], "session_id string, proxy string, cookies string, headers map<string,string>")
    changes = spark.createDataFrame([("a", 1, "x", {}), ("a", 2, "y", None), ("z", 1, "q", {})], kind)
    got = {r["session_id"]: (r["cookies"], r["headers"]) for r in upserts.update_sessions(sessions, changes).collect()}
    assert got == {"a": ("y", None), "b": ("old", None)}


def test_vectors_are_taken_all_or_none(spark):
    chunks = spark.createDataFrame([("u", 0, "a"), ("u", 1, "b"), ("v", 0, "c"), ("w", 0, "unknown")], "url string, chunk_index int, chunk string")
    embedder = embedding.ReplayEmbedder({"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [1.0]}, 2)
    points = embedding.embedded(chunks, embedder)
    assert [(r["url"], r["vector"]) for r in points.orderBy("chunk_index").collect()] == [("u", [1.0, 2.0]), ("u", [3.0, 4.0])]
    assert embedding.embedded(chunks, None).count() == 0
    pages = spark.createDataFrame(
        [("u", [("n", "T"), (" ", "T")], [("s", "is a", "o"), ("s", "1;drop", "o"), ("", "is", "o")]), ("v", [], None)],
        "url string, entities array<struct<name:string,type:string>>, triples array<struct<subject:string,predicate:string,object:string>>",
    )
    given = points.select("url", "vector").union(spark.createDataFrame([("v", [1.0])], "url string, vector array<double>"))
    assert sorted(map(tuple, embedding.stored_counts(pages, given, 2).collect())) == [("u", 1, 1, 2), ("v", 0, 0, 0)]


def test_names_fold_and_stored_mentions(spark):
    rows = [(1, "u", [("Straße", "place")], []), (2, "v", [("STRASSE ", None)], [])]
    pages = spark.createDataFrame(rows, "seq long, url string, entities array<struct<name:string,type:string>>, triples array<struct<subject:string,predicate:string,object:string>>")
    assert [(r["label"], r["type"]) for r in graph.nodes(pages).collect()] == [("Straße", "PLACE")]
    stored = spark.createDataFrame([("u", 1, "One"), ("u", 2, ""), (" ", 3, "x")], "url string, at long, title string")
    # the last write decides, also where it has no title
    assert [tuple(r) for r in graph.page_nodes(stored).collect()] == [("u", None, None, 1, 2, {})]
    kind = "url string, at long, title string, job_id string, metadata map<string,string>"
    told = [("u", 1, "One", "j", {"a": "1", "b": "1"}), ("u", 3, "Three", "", {"b": None, "c d": "x"}), ("u", 2, "Two", "k", {"b": "2"}), ("v", 1, None, None, None)]
    got = {r["url"]: tuple(r)[1:] for r in graph.page_nodes(spark.createDataFrame(told, kind)).collect()}
    assert got == {"u": ("Three", None, 1, 3, {"a": "1", "b": "2"}), "v": (None, None, 1, 1, {})}
    entities, edges = graph.mention_edges(pages.withColumnRenamed("seq", "at"))
    assert entities.count() == 2 and edges.where("mentions = 1").count() == 2


def test_pages_of_several_windows_are_checked_again(spark):
    class Answers:
        def complete(self, prompt):
            return json.dumps({"data": {"rows": [{"name": "first" if "alpha" in prompt else "second"}]}, "citations": {}})

    schema = {"type": "object", "properties": {"rows": {"type": "array", "maxItems": 1}}}
    text = "\n\n".join([" ".join(["alpha"] * 10), " ".join(["beta"] * 10), " ".join(["gamma"] * 10)])
    pages = spark.createDataFrame([("u", text), ("v", "alpha only")], "url string, markdown string")
    got = {r["url"]: r for r in structured.extract_pages(pages, Answers(), "rows", schema, budget=10, most=2).collect()}
    assert got["u"]["windows"] == 2 and got["u"]["windows_skipped"] == 1 and got["u"]["schema_errors"] and not got["v"]["schema_errors"]


def test_archived_results(spark):
    stored = spark.createDataFrame([], EXTRACTION_RESULTS).limit(0)
    row = spark.createDataFrame([(1, "j", "u")], "id long, job_id string, url string")
    stored = stored.unionByName(row, allowMissingColumns=True)
    got = jobs.results_or_archived(stored.limit(0), stored, "j")
    assert got["job"].first()["status"] == "archived" and got["pages"].count() == 1
    assert jobs.results_or_archived(stored, stored.limit(0), "j")["job"].first()["status"] == "held"
    with pytest.raises(KeyError):
        jobs.results_or_archived(stored, stored, "k")


def test_screens(spark):
    dump = '<hierarchy><node clickable="true" text=" Go " bounds="[0,10][20,30]" resource-id="r"/><node text=""/><node focusable="true" checkable="true" bounds="x"/></hierarchy>'
    rows = spark.createDataFrame([(dump,), ("<hierarchy><node",), ("no dump",), (None,)], "dump string").select(screens.elements(F.col("dump")).alias("e"))
    first, *rest = [r["e"] for r in rows.collect()]
    assert [(n["text"], n["x"], n["y"], n["clickable"], n["checkable"]) for n in first] == [("Go", 10, 20, True, False), ("", 0, 0, False, True)] and rest == [[], [], []]


def test_providers():
    assert providers.resolve({}).provider == "openai" and providers.resolve({}).base_url is None
    local = providers.resolve({"OPENAI_API_KEY": "ollama"}, defaults={"local": "m"}, vision_defaults={"local": "v"})
    assert local.flavour == "local" and local.base_url.endswith(":11434/v1") and (local.model, local.vision_model) == ("m", "v")
    assert providers.resolve({"OPENAI_API_BASE": "http://localhost:9/"}).api_key == "ollama"
    groq = providers.resolve({"GROQ_API_KEY": "k", "MODEL_NAME": "x", "VISION_MODEL_NAME": "y"})
    assert (groq.provider, groq.api_key, groq.model, groq.vision_model) == ("groq", "k", "x", "y") and "groq" in groq.base_url
    assert providers.resolve({"GOOGLE_API_KEY": "g"}).api_key == "g" and providers.resolve({"GROQ_API_KEY": "k"}, provider="openai", base_url="https://h/").base_url == "https://h"
    assert providers.resolve({"GEMINI_API_KEY": "g", "GEMINI_MODEL": "p"}).vision_model == "p"


@pytest.mark.parametrize("key", ["nokey", "no-key", "None", " LOCAL "])
def test_local_keys(key):
    found = providers.resolve({"OPENAI_API_KEY": key}, defaults={"local": "m", "openai": "hosted"})
    assert (found.flavour, found.model, found.base_url) == ("local", "m", None)
    assert providers.embedding_provider({"OPENAI_API_KEY": key}) == "none"


def test_local_hosts_and_embedders():
    found = providers.resolve({"OPENAI_API_BASE": "http://host.docker.internal:11434/v1"})
    assert (found.flavour, found.api_key) == ("local", "ollama")
    studio = providers.resolve({"OPENAI_API_KEY": "lm-studio"})
    assert (studio.flavour, studio.base_url) == ("local", "http://localhost:1234/v1")
    assert providers.resolve({"OPENAI_API_KEY": "lm-studio", "OPENAI_API_BASE": "https://far/v1"}).flavour == "openai"
    real = {"OPENAI_API_KEY": "sk"}
    assert [providers.embedding_provider(real, *x) for x in ((), (None, True), (None, False, True), ("Other",))] == ["openai", "openai", "sentence-transformers", "other"]
    assert providers.embedding_provider({"EMBEDDING_PROVIDER": "openai", "OPENAI_API_KEY": "none"}) == "openai" and providers.embedding_provider({}) == "none"
    assert providers.image_url(b"ab") == "data:image/png;base64,YWI="


def test_vectors_are_asked_for_in_batches(spark, tmp_path):
    class Counting:
        width = 1

        def embed(self, texts):
            assert len(texts) <= 64
            with open(f"{tmp_path}/asked", "a") as out:
                out.write(f"{len(texts)}\n")
            return [[float(t)] for t in texts]

    chunks = spark.createDataFrame([("u", n, str(n)) for n in range(130)], "url string, chunk_index int, chunk string")
    got = sorted(embedding.embedded(chunks, Counting()).collect(), key=lambda r: r["chunk_index"])
    assert [r["vector"] for r in got] == [[float(n)] for n in range(130)]
    assert (tmp_path / "asked").read_text().split() == ["64", "64", "2"]


def test_health_rows_and_results(spark):
    reports = spark.createDataFrame([("a", "u", "200.0", None, "true", ""), ("b", "u", "x", "7", None, "no")], "api_id string, url string, status_code string, latency_ms string, is_up string, error_message string")
    assert [tuple(r)[:-1] for r in apis.health_rows(reports).orderBy("api_id").collect()] == [("a", None, "u", 200, 0, True, None), ("b", None, "u", 0, 7, False, "no")]
    kind = "job_id string, url string, summary string, entities array<struct<name:string,type:string>>, created_at timestamp_ntz, extra int"
    entries = spark.createDataFrame([("j", "b", "s", None, None, 1), ("j", "c", "", [], None, 1), ("j", "a", None, [("n", "T")], None, 1)], kind)
    rows = upserts.result_rows(entries.withColumn("created_at", F.timestamp_seconds(F.ascii("url"))), 5)
    assert rows.columns == spark.createDataFrame([], EXTRACTION_RESULTS).columns
    assert [(r["id"], r["url"], r["data"], r["topics"], r["citations"]) for r in rows.orderBy("id").collect()] == [(6, "a", "{}", [], {}), (7, "b", "{}", [], {})]
    many = upserts.numbered(spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10), "n", "k", "id")
    assert [(r["k"], r["id"]) for r in many.orderBy("n").collect()] == sorted((n % 10, n) for n in range(1000)) and many.agg(F.max("n"), F.count_distinct("n")).first() == (1000, 1000)


def test_files_and_command_line(spark, tmp_path):
    calls = spark.createDataFrame([(1, "GET", "h", "/p", "application/json", "{}", '{"a":1}')], "seq long, method string, host string, path string, content_type string, request string, response string")
    apis.write_openapi(apis.openapi_operations(calls), "T", f"file://{tmp_path}/openapi.json")
    assert "/p" in json.loads((tmp_path / "openapi.json").read_text())["paths"]
    entries = catalogue.catalogue(spark)
    catalogue.write_texts(entries.limit(1), f"file://{tmp_path}/texts")
    assert len(list((tmp_path / "texts").glob("api-*"))) == 2
    probes = spark.createDataFrame([("api-ai-07", True), ("api-news-03", False), ("unknown", False)], "api_id string, failed boolean")
    assert [r["api_id"] for r in catalogue.checked(entries, probes).collect()] == ["api-news-03"]
    rows = [(1, "http://s/", '<p>start here now</p><a href="/a">a</a>'), (2, "http://s/a", "<p>another page</p>"), (3, "http://s/b", "<p>far</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    assert main(["crawl", "--pages", f"{tmp_path}/pages", "--url", "http://s/", "--output", f"file://{tmp_path}/report.json"]) == 0
    assert json.loads((tmp_path / "report.json").read_text())["pages_crawled"] == 2
