"""DataFrame operators on small tables whose results are known by hand."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from citelake.functions import html
from citelake.functions import text as T
from citelake.functions.registry import register
from citelake.operators import apis, chunking, dedup, evaluation, export, frontier, graph, markdown, structured, vectors
from citelake.operators.quotes import quotes_on_page
from citelake.plans import queries as plans
from citelake.plans.pages import crawl, page_terms
from citelake.session import Settings
from citelake.sources import catalogue, upserts
from citelake.sources.tables import counts, fixtures, page_by_url, recent, table


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_split_at_every_unicode_space(spark):
    assert one(spark, T.words(F.lit("a b\x1cc  d\n"))) == ["a", "b", "c", "d"]
    assert one(spark, T.words(F.lit(None).cast("string"))) == []


def test_chunks_follow_size_and_step(spark):
    text = F.lit(" ".join(map(str, range(40))))
    assert [c.split()[0] for c in one(spark, T.chunks(text, 10, 5))] == ["0", "5", "10", "15", "20", "25", "30", "35"]
    assert [len(c.split()) for c in one(spark, T.chunks(text, 10, 10))] == [10, 10, 10, 10]
    assert one(spark, T.chunks(F.lit(" "))) == []


def test_shingles_and_jaccard_agree_with_the_pure_form(spark):
    a, b = "the quick brown fox jumps over it", "The quick brown fox jumps again"
    assert set(one(spark, T.shingles(F.lit(a)))) == html.shingle_set(a)
    assert one(spark, T.jaccard(T.shingles(F.lit(a)), T.shingles(F.lit(b)))) == html.jaccard(html.shingle_set(a), html.shingle_set(b))
    assert one(spark, T.jaccard(T.shingles(F.lit("a")), T.shingles(F.lit("a")))) == 0.0


@pytest.mark.parametrize(
    "candidate, site, expected",
    [("api.example.com", "https://www.example.com/x", True), ("example.com:8080", "http://example.com", True), ("cdn.example.net", "http://example.com", False), ("notexample.com", "http://example.com", False), ("a", "nonsense", False)],
)
def test_first_party(spark, candidate, site, expected):
    assert one(spark, T.is_first_party(F.lit(candidate), F.lit(site))) is expected


def test_scalar_functions(spark):
    assert one(spark, T.point_id(F.lit("http://a"), F.lit(3), str(uuid.NAMESPACE_URL))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://a#3"))
    assert one(spark, T.number_of(F.lit("about 1,234.5 m"))) == 1234.5 and one(spark, T.number_of(F.lit("1 2"))) is None
    assert one(spark, T.csv_cell(F.lit("=A1"))) == "'=A1" and one(spark, T.csv_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, T.redact_dsn(F.lit("postgres://u:secret@h/db"))) == "postgres://u:***@h/db"
    assert one(spark, T.target_url(F.lit("see https://a.org/x). now"))) == "https://a.org/x"
    assert one(spark, T.target_url(F.lit("open localhost:3000/a"))) == "http://localhost:3000/a"
    assert one(spark, T.target_url(F.lit("crawl docs.example.com please"))) == "https://docs.example.com"
    assert one(spark, T.target_url(F.lit("version 1.2 of it"))) is None
    assert one(spark, T.bounds(F.lit("[0,10][21,31]"))).asDict() == {"x1": 0, "y1": 10, "x2": 21, "y2": 31, "x": 10, "y": 20}
    assert one(spark, T.bounds(F.lit("bad")))["x2"] == 0
    assert one(spark, T.relationship_type(F.lit(" works at "))) == "WORKS_AT" and one(spark, T.relationship_type(F.lit("a-b"))) is None
    assert one(spark, T.is_permanent_error(F.lit(404), F.lit("X"))) and one(spark, T.is_permanent_error(F.lit(429), F.lit("BadRequestError")))
    assert not one(spark, T.is_permanent_error(F.lit(500), F.lit("Timeout")))
    assert one(spark, T.refuses_json_mode(F.lit(400), F.lit("response_format not supported"))) and not one(spark, T.refuses_json_mode(F.lit(500), F.lit("unsupported")))
    assert one(spark, T.is_local_endpoint(F.lit("http://localhost:1/v1"), F.lit("k"))) and one(spark, T.is_local_endpoint(F.lit("http://h"), F.lit("Ollama")))
    assert one(spark, T.devices(F.lit("List of devices\nabc\tdevice\ndef\toffline\n"))) == ["abc"]
    assert one(spark, T.scroll_delta(F.lit(900), F.lit(600))) == 600.0 and one(spark, T.scroll_delta(F.lit(5), F.lit(600))) == 0.0
    assert one(spark, T.truncate(F.lit("a b c"), 2)) == "a b c"[:8] + "\n\n[...truncated...]"
    assert one(spark, T.is_static_asset(F.lit("http://h/A.PNG?x=1"))) and not one(spark, T.is_static_asset(F.lit("http://h/a.json")))
    assert one(spark, T.sample_value(F.lit("5"))) == '{"raw":"5"}' and one(spark, T.sample_value(F.lit(None).cast("string"))) == "{}"
    assert one(spark, T.retry_delay(F.lit(2))) == 8.0


def chain(spark):
    """a ~ b ~ c, but a is not like c: greedy keeps a and c."""
    words = [f"w{n}" for n in range(60)]
    b = words[:]
    a = ["x0", "x1", "x2", "x3"] + words[4:]
    c = words[:-4] + ["y0", "y1", "y2", "y3"]
    texts = {1: " ".join(a), 2: " ".join(b), 3: " ".join(c), 4: " ".join(b), 5: "too short", 6: "too short", 7: None}
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_greedy_choice_differs_from_components(spark):
    docs = chain(spark)
    similar = {(r["a"], r["b"]) for r in dedup.similar_pairs(dedup.shingle_sets(docs)).collect()}
    assert similar == {(1, 2), (2, 3)}
    kept = {r["doc_id"] for r in dedup.greedy_keep(docs).where("kept").collect()}
    assert kept == {1, 3, 5, 6, 7}


def test_greedy_choice_equals_the_sequential_one(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    held, want = [], set()
    for doc_id, text in texts:
        own = html.shingle_set(text) if len(text) >= 40 else frozenset()
        if not own or all(html.jaccard(own, o) < 0.85 for o in held):
            want.add(doc_id)
            if own:
                held.append(own)
    assert {r["doc_id"] for r in dedup.greedy_keep(docs).where("kept").collect()} == want


def test_dedup_of_an_empty_table(spark):
    assert dedup.greedy_keep(chain(spark).limit(0)).count() == 0


def test_terms(spark):
    docs = spark.createDataFrame([(1, "b a A c"), (2, None)], "doc_id long, text string")
    assert rows(chunking.top_terms(docs, 2)) == [(1, 1, "a", 2, 0.5), (1, 2, "b", 1, 0.25)]


def test_vector_search(spark):
    data = [(n, [1.0, n / 10, 0.0], n % 2) for n in range(10)] + [(10, [0.0, 0.0, 0.0], 0), (11, [1.0], 0)]
    stored = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    assert [r["vec_id"] for r in vectors.search(stored, [1, 0, 0], 3).collect()] == [0, 1, 2]
    assert [r["vec_id"] for r in vectors.search(stored, [1, 0, 0], 3, label=1).collect()] == [1, 3, 5]
    assert all(r["score"] >= 0.9 for r in vectors.search(stored, [1, 0, 0], 20, 0.9).collect())
    many = vectors.search_many(stored.where("vec_id < 10"), stored.where("vec_id in (0, 9)"), 2, block=1)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in many.collect()) == [(0, 1, 1), (0, 2, 2), (9, 1, 8), (9, 2, 7)]
    with pytest.raises(ValueError):
        upserts.vector_points(stored, 3, "embedding")


def graph_pages(spark):
    schema = "seq long, url string, entities array<struct<name:string,type:string>>, triples array<struct<subject:string,predicate:string,object:string>>"
    data = [
        (1, "u1", [("Ada", "person"), (" ada ", "alien"), ("Acme", None)], [("ADA", "works at", "Acme"), ("Ada", "", "Acme")]),
        (2, "u2", [("Acme", "organization")], [("ada", "WORKS AT", "acme"), ("Acme", "in", "Paris")]),
        (3, "u3", None, None),
    ]
    return spark.createDataFrame(data, schema)


def test_graph(spark):
    pages = graph_pages(spark)
    found = graph.nodes(pages)
    assert sorted(rows(found.select("id", "label", "type"))) == [("n0", "Ada", "PERSON"), ("n1", "Acme", "ORGANIZATION"), ("n2", "Paris", "ENTITY")]
    assert sorted(rows(graph.edges(pages, found))) == [("n0", "n1", "works at", "u1"), ("n1", "n2", "in", "u2")]
    assert graph.nodes(pages, 2).count() == 2 and graph.edges(pages, graph.nodes(pages, 2)).count() == 1
    assert rows(graph.truncated(pages, 2)) == [(True,)] and rows(graph.truncated(pages, 3)) == [(False,)]
    stored = spark.createDataFrame([("a", "R", "b"), ("c", "S", "a")], "src string, rel string, dst string")
    assert rows(graph.neighbours(stored, "a")) == [("R", "b"), ("S", "c")]
    assert rows(graph.stats(stored.select("src"), stored.limit(0))) == [(2, 0)]


def site(spark):
    pages = {"/": "<a href='/a'>a</a><a href='/b#f'>b</a><a href='https://off.org/'>o</a><a href='mailto:x'>m</a>", "/a": "<a href='/c'>c</a><a href='/'>h</a>", "/b": "", "/c": "<a href='/d'>d</a>"}
    return spark.createDataFrame([(n, f"https://s.org{p}", h) for n, (p, h) in enumerate(pages.items())], "page_id long, url string, html string")


def test_crawl_by_depth_and_cap(spark):
    found = lambda *a: [r["url"][13:] for r in crawl(site(spark), "https://s.org/", *a).collect()]
    assert found(0) == ["/"] and found(1) == ["/", "/a", "/b"] and found(5) == ["/", "/a", "/b", "/c"] and found(5, 2) == ["/", "/a"]


def test_robots(spark):
    links = frontier.link_table(site(spark))
    robots = spark.createDataFrame([("s.org", "User-agent: *\nDisallow: /a")], "host string, text string")
    assert "https://s.org/a" not in {r["link"] for r in frontier.allowed(links, robots).collect()}
    assert frontier.allowed(links, robots.limit(0)).count() == links.count()


def test_robots_rules_decide_in_order(spark):
    from urllib.robotparser import RobotFileParser

    texts = {
        "a.org": "User-agent: *\nAllow: /x/open\nDisallow: /x\nDisallow: /q?\n\nUser-agent: Citelake\nCrawl-delay: 1\nDisallow: /own # not here\nDisallow:\n",
        "b.org": "Disallow: /\nUser-agent: *\nUser-agent: other\n\nDisallow: /\n",
        "c.org": "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /%C3%A9\nDisallow: /a%20b",
    }
    paths = ["", "/", "/x", "/x/open/1", "/q?a=1", "/q", "/own/1", "/é", "/%C3%A9t", "/a b", "/a+b", "/a%2Bb", "/%zz"]
    links = spark.createDataFrame([(f"https://{h}{p}",) for h in [*texts, "d.org"] for p in paths], "link string")
    got = {r["link"] for r in frontier.allowed(links, spark.createDataFrame(list(texts.items()), "host string, text string")).collect()}
    want = set()
    for host in [*texts, "d.org"]:
        rules = RobotFileParser()
        rules.parse(texts.get(host, "").splitlines())
        want |= {f"https://{host}{p}" for p in paths if rules.can_fetch(frontier.AGENT, f"https://{host}{p}")}
    # a URL with a space or a stray percent sign has no host for Spark, and what has no known host is allowed
    assert {x for x in got if " " not in x and "zz" not in x} == {x for x in want if " " not in x and "zz" not in x}


def test_crawls_follow_robots(spark):
    from citelake.plans.pages import crawl

    pages = spark.createDataFrame([("http://s/", '<a href="/a">a</a><a href="/b">b</a>'), ("http://s/a", '<a href="/c">c</a>'), ("http://s/b", ""), ("http://s/c", "")], "url string, html string")
    robots = spark.createDataFrame([("s", "User-agent: *\nDisallow: /b")], "host string, text string")
    visited = lambda *more: [(r["url"], r["depth"]) for r in crawl(pages, "http://s/", 2, 50, *more).collect()]
    assert visited() == [("http://s/", 0), ("http://s/a", 1), ("http://s/b", 1), ("http://s/c", 2)]
    assert visited(robots) == [("http://s/", 0), ("http://s/a", 1), ("http://s/c", 2)]
    assert visited(spark.createDataFrame([("s", "User-agent: *\nDisallow: /")], "host string, text string")) == []



def test_queue(spark):
    data = [("a", 1, "add", 0, 1), ("b", 2, "add", 2, 1), ("c", 3, "add", 0, 1), ("d", 9, "add", 0, 1), ("d", 10, "complete", 0, 1)] + [("c", n, "fail", 0, 1) for n in range(4, 8)]
    events = spark.createDataFrame(data, "url string, seq long, event string, depth int, max_depth int")
    assert sorted(rows(frontier.queue_states(events))) == [("a", "queued", 0), ("c", "dropped", 3), ("d", "completed", 0)]
    locked = spark.createDataFrame([("a", 10.0), ("b", 90.0)], "url string, lock_time double")
    assert rows(frontier.expired(locked, 100.0, 60.0)) == [("a", None)]


def test_responses_attach_to_the_latest_request(spark):
    events = spark.createDataFrame([(1, "u", "request"), (2, "u", "request"), (3, "u", "response"), (4, "v", "response")], "seq long, url string, kind string")
    assert sorted((r["seq"], r["request_seq"]) for r in apis.match_responses(events).collect()) == [(3, 2), (4, None)]


def test_schemas_merge_over_samples(spark):
    samples = spark.createDataFrame([("a", '{"x": 1}'), ("a", '{"x": 1.5, "y": "z"}'), ("b", "{")], "k string, j string")
    got = {r["k"]: json.loads(r["schema"]) for r in apis.schemas(samples, "j", "k").collect()}
    assert got["a"] == {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "string"}}, "required": ["x"]}
    assert got["b"]["type"] == "string"


def test_openapi_and_health(spark):
    calls = spark.createDataFrame([(1, "GET", "h", "/a", "application/json", None, '{"x": 1}'), (2, "GET", "h", "/p", "text/html", None, None)], "seq long, method string, host string, path string, content_type string, request string, response string")
    assert list(json.loads(apis.openapi_document(apis.openapi_operations(calls), "T"))["paths"]) == ["/a"]
    probes = spark.createDataFrame([("a", 200, 5, None, False), ("a", 503, 9, None, False), ("b", None, 1, None, True), ("c", None, 1, "boom", False)], "api_id string, status_code int, latency_ms int, error string, timed_out boolean")
    assert sorted(rows(apis.health_reports(probes).select("api_id", "status_code", "is_up"))) == [("a", 200, True), ("a", 503, False), ("b", 408, False), ("c", 0, False)]
    sessions = spark.createDataFrame([("a", 5, 9), ("b", 0, 0), ("c", 1, 1)], "session_id string, error_count long, success_count long")
    assert [r["session_id"] for r in apis.healthy_sessions(sessions, 1).collect()] == ["b"]


def test_catalogue(spark):
    apis_ = catalogue.catalogue(spark)
    assert apis_.count() == 15 and catalogue.categories(apis_).count() == 15
    assert catalogue.by_category(apis_, "weather").count() == 1 and catalogue.search(apis_, "NASA").count() == 2
    more = catalogue.register(apis_, {"name": "N", "base_url": "https://n", "category": "C"})
    assert catalogue.get(more, "api-custom-16").count() == 1
    with pytest.raises(ValueError):
        catalogue.register(apis_, {"name": "N"})
    assert "0000" in catalogue.get(catalogue.probe_targets(apis_), "api-chain-14").first()["url"]


def test_keyed_writes(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    merged = upserts.upsert(stored, spark.createDataFrame([("a", 2, "z")], "k string, v int, s string"), ["k"], "v")
    assert sorted(rows(merged)) == [("a", 2, "z"), ("b", 1, "y")]
    assert rows(upserts.delete(stored, stored.where("k = 'a'"), ["k"])) == [("b", 1, "y")]
    assert spark.read.parquet(upserts.overwrite(merged, str(tmp_path))).count() == 2
    named = spark.createDataFrame([(" A ", None, "person", "u"), ("", "x", "y", "u"), ("B", " ", None, "u")], "name string, entity_type string, type string, page_url string")
    assert sorted(rows(upserts.entity_rows(named))) == [("A", "PERSON", "u"), ("B", "ENTITY", "u")]


def test_lists(spark):
    events = spark.createDataFrame([(n, n % 3, f"t{n % 2}") for n in range(9)], "id int, ts int, kind string")
    assert [r["id"] for r in recent(events, "ts", "id", 2, 1, kind="t0").collect()] == [2, 4]
    assert recent(events, "ts", "id", 99, kind=" ").count() == 9
    with pytest.raises(ValueError):
        counts({"x": events}, ("y",))
    assert page_by_url(site(spark), " https://s.org/a ").count() == 1


def test_structured_flow(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}
    pages = spark.createDataFrame([("u", "para one says 41\n\npara two says 42")], "url string, markdown string")
    cut = structured.window_table(pages, 4)
    assert cut.count() == 2

    class Fixed:
        def complete(self, prompt):
            return '{"data": {"n": 42}, "citations": {"n": "says 42"}}' if "42" in prompt else '{"data": {"n": "x"}}'

    parts = structured.extract(cut, Fixed(), "find n", schema)
    found = {r["window"]: (json.loads(r["data"]), list(r["citations"]), r["unverified"]) for r in parts.collect()}
    assert found[1] == ({"n": 42}, ["/n"], []) and found[0][2] == ["/n"]
    merged = structured.merge(parts, "url", "window").first()
    assert json.loads(merged["data"]) == {"n": 42} and list(merged["citations"]) == ["/n"] and merged["unverified"] == []
    replies = spark.createDataFrame([("u", "page", "junk"), ("v", None, None)], "url string, page string, reply string")
    assert {r["data"] for r in structured.verify_replies(replies).collect()} == {"{}"}


def test_all_windows_are_returned(spark):
    pages = spark.createDataFrame([("u", "\n\n".join(f"w{k} a b" for k in range(12))), ("v", "one"), ("w", None)], "url string, markdown string")
    cut = structured.window_table(pages, 3)
    assert [r["text"] for r in cut.where("url = 'u'").orderBy("window").collect()] == [f"w{k} a b" for k in range(12)]
    first = {(r["url"], r["window"], r["windows_skipped"]) for r in structured.first_windows(cut).collect()}
    assert first == {("u", 0, 8), ("u", 1, 8), ("u", 2, 8), ("u", 3, 8), ("v", 0, 0)}


def test_quotes_on_pages(spark):
    quotes = spark.createDataFrame([(1, "the “Pro” plan"), (1, "absent"), (2, "x")], "k int, quote string")
    pages = spark.createDataFrame([(1, 'The **"Pro"** plan')], "k int, text string")
    assert sorted((r["k"], r["quote"], r["found"]) for r in quotes_on_page(quotes, pages, "k").collect()) == [(1, "absent", False), (1, "the “Pro” plan", True), (2, "x", False)]



def test_export(spark):
    result = {"data": {"x": 1, "rows": [{"a": "=H()", "b": 2}, {"c": None}]}, "citations": {"/rows/0/a": [{"quote": "q", "url": "u2"}, {"quote": "q", "url": "u1"}]}}
    name, columns, lines = export.structured_table(result)
    assert (name, columns, lines) == ("rows", ["a", "b", "c", "sources"], [["'=H()", "2", "", "u1 u2"], ["", "", "", ""]])
    assert export.structured_table(result, "x") is None and export.to_csv(columns, lines).startswith("a,b,c,sources\r\n")
    assert rows(export.json_lines(spark.createDataFrame([(1, None)], "a int, b string"))) == [('{"a":1,"b":null}',)]
    jobs = spark.createDataFrame([("j", 1.0, 2.0, 4.5, ["e"] * 30)], "job_id string, created_at double, started_at double, finished_at double, errors array<string>")
    assert (len(export.job_view(jobs).first()["errors"]), export.job_view(jobs).first()["duration_s"]) == (20, 2.5)
    report = export.command_line_report(spark.createDataFrame([(1, "u", "m")], "seq int, url string, markdown string"), "u", 1, 0).first()["value"]
    assert json.loads(report)["pages_crawled"] == 1


def test_evaluation(spark):
    gold = [{"name": "A", "price": "1"}]
    task = json.dumps({"records_field": "r", "key": "name", "fields": ["name", "price"]})
    data = [("f1", task, json.dumps(gold), json.dumps({"r": gold})), ("f2", task, json.dumps(gold), "junk")]
    scores = evaluation.score_fixtures(spark.createDataFrame(data, "fixture string, task string, gold string, data string"))
    summary = evaluation.summarise(scores).first()
    assert (summary["fixtures"], summary["precision"], summary["recall"], summary["macro_f1"]) == (2, 1.0, 0.5, 0.5)
    assert evaluation.summarise(scores.limit(0)).first()["f1"] == 0.0


def test_fixture_folders(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "task.json").write_text("{}")
        (tmp_path / name / "gold.json").write_text("[]")
    (tmp_path / "a" / "page.html").write_text("<p>x</p>")
    assert [(r["fixture"], r["html"]) for r in fixtures(spark, str(tmp_path)).collect()] == [("a", "<p>x</p>"), ("b", None)]
    assert fixtures(spark, str(tmp_path), ("b",)).count() == 1


def test_flagship_and_functions(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    terms = page_terms(pages, 3)
    assert terms.columns == ["page_id", "url", "chunks", "rank", "term", "n", "tf"] and 0 < terms.count() <= 150
    assert "html_to_markdown" in register(spark)
    got = spark.sql("SELECT html_to_markdown('<p>a</p>') AS m, normalize_text('Ａ *b*') AS t").first()
    assert (got["m"], got["t"]) == ("a", "a b")
    assert markdown.page_titles(pages).columns == ["page_id", "url", "title"]


def test_terms_count_repeated_blocks_on_request(spark):
    line = "one two three four five six seven eight nine ten"
    pages = spark.createDataFrame([(1, "u", f"<div>{line}</div><h1>{line}</h1>")], "page_id long, url string, html string")
    assert {r["n"] for r in page_terms(pages).collect()} == {1}
    assert {(r["term"], r["n"]) for r in page_terms(pages, 11, repeats=True).collect()} == {*((w, 2) for w in line.split()), ("#", 1)}


def test_settings():
    got = Settings.from_environment({"CITELAKE_CHUNK_WORDS": "20", "CITELAKE_BATCH": "x", "CITELAKE_WINDOWS": "-1"})
    assert (got.chunk_words, got.batch, got.windows) == (20, 64, 4)


def test_visits(spark):
    rows = [("a", n, "refused") for n in range(4)] + [("a", 4, "ok"), ("b", 0, "refused"), ("b", 1, "timeout"), ("b", 2, "refused"), ("c", 0, "refused"), ("d", 0, "ok")]
    got = {tuple(r) for r in frontier.visits(spark.createDataFrame(rows, "url string, attempt int, outcome string")).collect()}
    assert got == {("a", "dropped", 3), ("b", "completed", 1), ("c", "queued", 1), ("d", "completed", 0)}


def test_target_urls_take_numbers_of_a_host_whole(spark):
    assert one(spark, T.target_url(F.lit("10.0.0.1063/x"))) == "http://10.0.0.1063/x"
    assert one(spark, T.target_url(F.lit("see 10.0.0.1 now"))) == "http://10.0.0.1"


def _stored(spark, folder, **tables):
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return f"file://{folder}"


def test_links_of_a_url_that_is_stored_twice(spark, tmp_path):
    html = "<a href=\"/x\">x</a><a href=\"/in\">y</a>"
    d = _stored(spark, tmp_path, pages=([(1, "http://h/", html), (2, "http://h/", html)], "page_id long, url string, html string"))
    assert sorted(rows(plans.QUERIES["extract_links"](spark, d))) == [("http://h/", "http://h/in"), ("http://h/", "http://h/x")]
    assert sorted(rows(plans.QUERIES["robots_links"](spark, d))) == [("http://h/", "http://h/in"), ("http://h/", "http://h/x")]


def test_latencies_are_rounded_half_to_even(spark, tmp_path):
    d = _stored(spark, tmp_path, events=([(n, "view", 1.25) for n in range(3)], "event_id long, event_type string, value double"))
    assert rows(plans.QUERIES["health_rollup"](spark, d)) == [("view", 3, 1.0, 12, 12)]


def test_entities_of_lines_with_one_number(spark, tmp_path):
    d = _stored(spark, tmp_path, part=([(1, "b")], "p_partkey long, p_brand string"), lineitem=(
        [(1, 1, 1, "O"), (7, 1, 1, "F"), (7, 1, 1, "Z"), (7, 1, 1, "A")], "l_orderkey long, l_linenumber int, l_partkey long, l_linestatus string"))
    assert rows(plans.QUERIES["mentioned_entities"](spark, d)) == [("b", "F", 11, 71)]
    assert sorted(rows(plans.QUERIES["mention_edges"](spark, d))) == [("1", "b", 1, 11), ("7", "b", 1, 71)]


def test_sets_hashed_in_arrow_equal_the_columns(spark):
    """Words between all white space, the same sets and the same pairs as by ``text.shingles``, and no set is stored or dealt out."""
    wide = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    other = "".join(map(chr, [0x84, 0xA1, 0x1681, 0x200B, 0x2027, 0x202A, 0x2060, 0x3001, 0x1F600]))
    spread = "".join(f"{c}W{n % 7}" for n, c in enumerate(wide * 2))
    texts = [spread, " ".join(spread.split()), f"A b c d e {other} f " * 3, "a b c d", "", None, " É É é é é x", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(T.shingles(F.col("text"))).alias("n")).where("n > 0").collect()}
    sets = docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    got = {r["id"]: r for r in sets.mapInArrow(dedup._digested(5), "id long, n long, x long, y long").collect()}
    assert {i: r["n"] for i, r in got.items()} == want and got[0][1:] == got[1][1:] and len({r[1:] for r in got.values()}) == len(got) - 1
    pairs = dedup.similar_pairs(dedup.shingle_sets(chain(spark)))
    assert {tuple(r) for r in pairs.collect()} == {(1, 2, 52, 60), (2, 3, 52, 60)}
    dealt = pairs._jdf.queryExecution().optimizedPlan().toString() + dedup.shingle_sets(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in dealt and "array_intersect" not in dealt and "members" not in dealt
