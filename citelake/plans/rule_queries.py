"""Queries of small rules over strings, states and events that are made from the tables' rows, and SQL that says what must come out."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions import text as T
from citelake.functions.registry import register
from citelake.operators import apis, frontier, jobs, structured
from citelake.operators.shared import scratch, written
from citelake.plans.queries import query
from citelake.sources import snapshots, upserts
from citelake.sources.tables import extraction_results, page_by_url, table
from citelake.streaming import jobs as streams
from citelake.streaming import subscriptions


def _turn(column, *values):
    """One of ``values`` by ``column`` modulo their number."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT event_id, (ARRAY['#top', 'JavaScript:x', ' mailto:a@b', 'http://h/' || user_id, ' https://h.org?y ', 'ftp://x', '/rel', 'http:///x'])[event_id % 8 + 1] AS href,
        event_id % 8 < 3 AS skipped, event_id % 8 IN (3, 4) AS web, event_id % 4 < 2 AS document, event_id % 5 IN (0, 3) AS identifier FROM events""")
def url_rules(spark, d):
    """Links that are not followed, URLs that can be fetched, content types that are documents, names that are identifiers."""
    n, user = F.col("event_id"), F.col("user_id")
    href = _turn(n, "#top", "JavaScript:x", " mailto:a@b", _said("http://h/", user), " https://h.org?y ", "ftp://x", "/rel", "http:///x")
    kind = _turn(n, "Text/HTML; charset=utf-8", "application/xhtml+XML", "application/json", F.lit(None).cast("string"))
    name = _turn(n, " rel_1 ", "1rel", "a-b", "_x", "")
    rows = table(spark, d, "events").select("event_id", href.alias("href"), kind.alias("kind"), name.alias("name"))
    c = F.col
    return rows.select("event_id", "href", T.is_skipped_link(c("href")).alias("skipped"), T.is_web_url(c("href")).alias("web"), T.is_document(c("kind")).alias("document"), T.is_identifier(c("name")).alias("identifier"))


@query("""SELECT event_id, (ARRAY['https://x.org/a' || user_id, 'https://example.com/p' || user_id, 'http://localhost:80' || user_id % 10, 'http://10.0.0.' || user_id || '/x', 'none'])[event_id % 5 + 1] AS target FROM events""")
def request_targets(spark, d):
    """The page that a request in words is about."""
    n, user = F.col("event_id"), F.col("user_id")
    said = _turn(n, _said("Go to https://x.org/a", user, "."), _said("please open example.com/p", user, " now"), _said("see localhost:80", user % 10), _said("10.0.0.", user, "/x"), "Tell me a story")
    return table(spark, d, "events").select("event_id", F.coalesce(T.target_url(said), F.lit("none")).alias("target"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, x2, y2, (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y,
        CASE WHEN l_partkey BETWEEN 0 AND 499 THEN 0.0 ELSE l_partkey - 250.0 END::DOUBLE AS delta, 'S' || l_partkey || ',T' || l_suppkey AS devices
        FROM (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber END AS x1, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_suppkey::INTEGER END AS y1,
              CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber + 7 END AS x2, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_partkey::INTEGER END AS y2 FROM lineitem)""")
def screen_rules(spark, d):
    """Places on screens, how far to scroll, and attached devices."""
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    box = T.bounds(F.when(n % 4 == 0, _said("[", n, ",", supp, "]")).otherwise(_said("[", n, ",", supp, "][", n + 7, ",", part, "]")))
    listing = _said("List of devices attached\nS", part, "\tdevice\nU1\toffline\n  T", supp, " device usb:1\n\nU2\tunauthorized")
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b"), T.scroll_delta(part, F.lit(500)).alias("delta"), T.devices(listing).alias("devices"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "b.*", F.col("delta").cast("double").alias("delta"), F.array_join("devices", ",").alias("devices"))


@query("""SELECT event_id, event_id % 6 IN (1, 2) OR event_id % 5 = 3 AS permanent, event_id % 6 IN (0, 1, 5) AND event_id % 4 IN (0, 2) AS refused,
        event_id % 7 IN (0, 2, 3, 6) AS local, 2.0 * pow(2, event_id % 4) AS delay FROM events""")
def error_rules(spark, d):
    """Errors that no retry mends, refusals of the JSON mode, endpoints on this machine, and the wait before a retry."""
    n = F.col("event_id")
    none = F.lit(None).cast("int")
    status = _turn(n, none, 400, 403, 429, 500, none)
    name = _turn(n, "Timeout", "RateLimit", "", "my.NotFoundError", F.lit(None).cast("string"))
    message = _turn(n, "Response_Format is wrong", "bad key", "JSON mode is not here", F.lit(None).cast("string"))
    base = _turn(n, "http://localhost:1/v1", "https://api.org", "http://127.0.0.1", F.lit(None).cast("string"), "https://localhost.org", "http://h/localhost", "https://far")
    key = _turn(n, "sk", "sk", "sk", " Ollama ", "sk", F.lit(None).cast("string"), "NONE")
    found = {"permanent": T.is_permanent_error(status, name), "refused": T.refuses_json_mode(status, message), "local": T.is_local_endpoint(base, key), "delay": T.retry_delay(n % 4)}
    return table(spark, d, "events").select("event_id", *[rule.alias(name) for name, rule in found.items()])


_STATES = """e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'step' END AS state FROM events WHERE event_id % 7 = 0 OR event_type IN ('signup', 'view'))"""


def _job_events(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "running", "purchase", "succeeded", "error", "failed", "click", "step")])[F.col("event_type")]
    rows = table(spark, d, "events").where("event_id % 7 = 0 or event_type in ('signup', 'view')")
    return rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.unix_timestamp("ts").alias("at"))


@query(f"""WITH {_STATES}, s AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS "at" FROM e WHERE state <> 'step')
        SELECT user_id AS job_id, coalesce(arg_min(state, event_id) FILTER (WHERE state IN ('succeeded', 'failed')), arg_max(state, event_id)) AS status, min("at") AS created_at,
               coalesce(min("at") FILTER (WHERE state = 'running'), -1) AS started_at, coalesce(min("at") FILTER (WHERE state IN ('succeeded', 'failed')), -1) AS finished_at FROM s GROUP BY user_id""")
def job_states(spark, d):
    """Users' events as those of jobs: a final state stays whatever comes after it."""
    found = jobs.states(_job_events(spark, d))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("started_at", "finished_at")})


@query("""WITH p AS (SELECT user_id, max(event_id) AS upto FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0 GROUP BY 1)
        SELECT e.user_id AS job_id, event_id AS seq, props AS message FROM events e LEFT JOIN p USING (user_id) WHERE event_type = 'error' AND event_id > coalesce(upto, -1)""")
def unpublished_errors(spark, d):
    events = table(spark, d, "events")
    errors = events.where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("props").alias("message"))
    told = events.where("event_type = 'purchase' and event_id % 2 = 0").groupBy(F.col("user_id").alias("job_id")).agg(F.max("event_id").alias("upto"))
    return jobs.unpublished(errors, told)


@query("""WITH s AS (SELECT user_id AS session_id, count(*) FILTER (event_type = 'error') % 8 AS error_count, count(*) FILTER (event_type = 'click') AS success_count,
               arg_max(props, event_id) FILTER (event_type = 'view' AND event_id % 5 = 0) AS cookies FROM events GROUP BY 1)
        SELECT session_id, error_count, success_count, coalesce(cookies, 'old') AS cookies FROM s WHERE error_count < 5
        ORDER BY CASE WHEN error_count + success_count = 0 THEN 1.0 ELSE success_count / (error_count + success_count) END DESC, session_id LIMIT 50""")
def session_pool(spark, d):
    """Sessions with their newest cookies, the best of those that did not fail too often."""
    events = table(spark, d, "events")
    held = events.groupBy(F.col("user_id").alias("session_id")).agg((F.count_if(F.col("event_type") == "error") % 8).alias("error_count"), F.count_if(F.col("event_type") == "click").alias("success_count"))
    held = held.withColumn("cookies", F.lit("old")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    changes = events.where("event_type = 'view' and event_id % 5 = 0").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("props").alias("cookies"), F.lit(None).cast("map<string,string>").alias("headers"))
    return apis.healthy_sessions(upserts.update_sessions(held, changes)).select("session_id", "error_count", "success_count", "cookies")


@query("""SELECT event_id, (ARRAY['12.50 usd', 'quoted"x', 'it''s', 'strasse 7', ''])[event_id % 5 + 1] AS folded,
        (ARRAY['/plans/0/price', '/plans/0/price', '/plans/' || user_id || '/price', '/a~1b', 'none'])[event_id % 5 + 1] AS pointer FROM events""")
def value_rules(spark, d):
    """Field values and pointers as they are compared."""
    register(spark)
    n, user = F.col("event_id"), F.col("user_id")
    value = _turn(n, " 12.50  USD ", "“quoted”x", "It’s…", "'Straße 7'", F.lit(None).cast("string"))
    pointer = _turn(n, "plans[0].price", "data.plans.0.price", _said("/data/plans/", user, "/price"), "/a~1b", " ")
    return table(spark, d, "events").select("event_id", F.call_function("normalize_value", value).alias("folded"), F.coalesce(F.call_function("normalize_pointer", pointer), F.lit("none")).alias("pointer"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    found = streams.event_counts(table(spark, d, "events"), "1 day", "1 day")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type FROM events WHERE event_id % 5 < 2 AND event_type <> 'view'),
        f AS (SELECT user_id, min(i) FILTER (event_type IN ('purchase', 'click')) AS done FROM a GROUP BY 1),
        c AS (SELECT a.user_id, any_value(done) AS done, count(*) FILTER (event_type NOT IN ('purchase', 'click') AND (done IS NULL OR i < done)) AS failures FROM a JOIN f USING (user_id) GROUP BY 1)
        SELECT user_id::VARCHAR AS url, CASE WHEN failures > 3 THEN 'dropped' WHEN done IS NOT NULL THEN 'completed' ELSE 'queued' END AS status, least(failures, 3) AS retries FROM c""")
def page_visits(spark, d):
    """Attempts to visit: pages that do not open are retried, handlers that take too long are not."""
    rows = table(spark, d, "events").where("event_id % 5 < 2 and event_type <> 'view'")
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "timeout").otherwise("refused")
    return frontier.visits(rows.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("attempt"), outcome.alias("outcome")))


@query("""SELECT o_orderkey AS id, 'order ' || o_orderkey AS summary, '{"n": ' || o_orderkey || '}' AS data FROM orders WHERE o_custkey % 100 = 1 ORDER BY o_orderkey LIMIT 500""")
def job_results(spark, d):
    """The stored results of one job, in order."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key.alias("id"), F.concat(F.lit("job "), F.col("o_custkey") % 100).alias("job_id"), _said("order ", key).alias("summary"), _said('{"n": ', key, "}").alias("data"),
        F.create_map().cast("map<string,string>").alias("citations"), F.array().cast("array<string>").alias("unverified"),
    )
    return extraction_results(rows, "job 1").select("id", "summary", "structured.data")


@query("SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages ORDER BY page_id LIMIT 1)")
def stored_page(spark, d):
    """The page of a URL, found by the URL's fingerprint."""
    pages = table(spark, d, "pages")
    return page_by_url(pages, f"  {pages.orderBy('page_id').first()['url']} ").select("page_id", "url")


class _Answers:
    """Answers out of the prompt itself; the first answer about an even number does not fit the schema, the second about a multiple of four neither."""

    def complete(self, prompt: str) -> str:
        number = int(re.search(r"The number is (\d+)", prompt)[1])
        again = "did not fit" in prompt
        fits = number % 2 or (again and number % 4)
        return json.dumps({"data": {"n": number if fits else str(number), "note": "The number"}, "citations": {"n": f"number is {number}"}})


@query("""SELECT 'https://e/' || event_id AS url, CASE WHEN event_id % 4 = 0 THEN '{"n": "' || event_id || '", "note": "The number"}' ELSE '{"n": ' || event_id || ', "note": "The number"}' END AS data,
        '/n /note' AS cited, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS errors FROM events WHERE event_id % 10 < 4""")
def extracted_numbers(spark, d):
    """Extraction with a second question where the first answer breaks the schema."""
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "note": {"type": "string"}}, "required": ["n"]}
    rows = table(spark, d, "events").where("event_id % 10 < 4").select(_said("https://e/", F.col("event_id")).alias("url"), F.lit(0).alias("window"), _said("The number is ", F.col("event_id"), ".").alias("text"))
    found = structured.extract(rows, _Answers(), "Find the number.", schema)
    return found.select("url", "data", F.array_join(F.map_keys("citations"), " ").alias("cited"), F.size("schema_errors").alias("errors"))


@query("""WITH cut AS (SELECT max(event_id) // 3 AS c FROM events), e AS (SELECT user_id, event_id, event_type, props FROM events WHERE user_id % 5 = 0),
        a AS (SELECT user_id, max(event_id) AS top, min(event_id) FILTER (event_type = 'purchase') AS e0 FROM e, cut WHERE event_id <= c GROUP BY 1),
        l AS (SELECT e.*, top FROM e JOIN a USING (user_id) WHERE e0 IS NULL AND event_id > top),
        b AS (SELECT user_id, any_value(top) AS top, count(*) AS n, min(event_id) FILTER (event_type = 'purchase') AS e1 FROM l GROUP BY 1),
        f AS (SELECT user_id, max(event_id) AS top, min(event_id) FILTER (event_type = 'purchase') AS e0 FROM e GROUP BY 1 HAVING user_id NOT IN (SELECT user_id FROM a))
        SELECT 0 AS turn, user_id AS job_id, 0 AS place, top AS seq, 'snapshot' AS event, props AS data FROM a JOIN e USING (user_id) WHERE event_id = top
        UNION ALL SELECT 0, user_id, 1, top, 'purchase', props FROM a JOIN e USING (user_id) WHERE event_id = top AND e0 IS NOT NULL
        UNION ALL SELECT 1, user_id, 0, top, 'snapshot', props FROM f JOIN e USING (user_id) WHERE event_id = top
        UNION ALL SELECT 1, user_id, 1, top, 'purchase', props FROM f JOIN e USING (user_id) WHERE event_id = top AND e0 IS NOT NULL
        UNION ALL SELECT 1, user_id, 0, top, 'dropped', n || ' events behind' FROM b WHERE n > 40
        UNION ALL SELECT 1, l.user_id, (row_number() OVER (PARTITION BY l.user_id ORDER BY event_id) - 1)::INTEGER, event_id, event_type, props
                  FROM l JOIN b ON b.user_id = l.user_id WHERE n <= 40 AND (e1 IS NULL OR event_id <= e1)""")
def event_deliveries(spark, d):
    """Two deliveries of users' events to subscribers: a snapshot, then what came later, up to a purchase."""
    events = table(spark, d, "events").where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("data"))
    cut = table(spark, d, "events").agg(F.floor(F.max("event_id") / 3)).first()[0]
    held = subscriptions.subscriptions(spark, scratch(spark, "subscriptions"), buckets=4)
    subscriptions.subscribe(held, events.select(F.lit("s").alias("subscriber"), "job_id").distinct(), 0)
    told = [subscriptions.deliver(rows, held, turn, 40, "purchase").withColumn("turn", F.lit(turn)) for turn, rows in enumerate((events.where(F.col("seq") <= cut), events))]
    return told[0].unionByName(told[1]).select("turn", F.col("job_id").cast("long").alias("job_id"), "place", "seq", "event", "data")


@query(r"""SELECT page_id % 3 AS round, url, CASE WHEN page_id % 7 = 0 THEN 'none' ELSE trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) END AS title,
        CASE WHEN page_id % 7 = 0 THEN 0 ELSE 200 END AS status, CASE WHEN page_id % 7 = 0 THEN 'timeout' ELSE 'none' END AS error FROM pages""")
def page_fetches(spark, d):
    """Pages stored in three rounds of fetching, some failed, read through the data source of stored fetches."""
    failed = F.col("page_id") % 7 == 0
    pages = table(spark, d, "pages").select("url", F.when(~failed, 200).alias("status"), "html", F.when(failed, "timeout").alias("error"), (F.col("page_id") % 3).alias("_round"))
    pages, folder = written(pages, "fetched"), scratch(spark, "rounds")
    for number in range(3):
        pages.where(F.col("_round") == number).drop("_round").write.parquet(f"{folder}/{number}")
    snapshots.register(spark)
    found = spark.read.format("page_snapshots").option("path", folder).option("loose", "false").load()
    none = F.lit("none")
    return found.select("round", "url", F.coalesce("title", none).alias("title"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("error", none).alias("error"))
