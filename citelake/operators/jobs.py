"""Jobs: their state, lists, results and what of them was already told or asked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import cache_key
from citelake.operators import graph, structured
from citelake.operators.export import job_view

JOBS_KEPT = 200
# States in the order in which a job can reach them.
STATES = ("queued", "running", "succeeded", "failed", "cancelled")
FINAL = STATES[2:]


def states(events: DataFrame) -> DataFrame:
    """Job events (``job_id, seq, event, at``) as ``job_id, status, created_at, started_at, finished_at``.

    The last event decides, but a final state stays whatever comes after it.
    """
    final = F.col("event").isin(*FINAL)
    return events.where(F.col("event").isin(*STATES)).groupBy("job_id").agg(
        F.coalesce(F.min_by(F.when(final, F.col("event")), F.when(final, F.col("seq"))), F.max_by("event", "seq")).alias("status"),
        F.min("at").alias("created_at"),
        F.min(F.when(F.col("event") == "running", F.col("at"))).alias("started_at"),
        F.min(F.when(final, F.col("at"))).alias("finished_at"),
    )


def listed(crawls: DataFrame, agents: DataFrame, limit: int = 50) -> DataFrame:
    """Jobs of both kinds, newest first, between 1 and ``JOBS_KEPT`` of them."""
    both = crawls.withColumn("kind", F.lit("crawl")).unionByName(agents.withColumn("kind", F.lit("agent")), allowMissingColumns=True)
    return job_view(both).limit(max(1, min(limit, JOBS_KEPT)))


def unpublished(errors: DataFrame, published: DataFrame) -> DataFrame:
    """Errors (``job_id, seq, message``) after the last one that was published (``job_id, upto``), in order."""
    told = published.select(F.col("job_id").alias("_job"), "upto")
    joined = errors.join(told, F.col("job_id") == F.col("_job"), "left")
    return joined.where(F.col("seq") > F.coalesce("upto", F.lit(-1))).select("job_id", "seq", "message").orderBy("job_id", "seq")


def results(rows: DataFrame, job_id: str) -> dict[str, DataFrame]:
    """What a job produced, from its stored rows (``EXTRACTION_RESULTS``): pages, merged structured data, graph."""
    pages = rows.where(F.col("job_id") == job_id)
    parts = pages.where(F.col("data").isNotNull()).select("job_id", "id", "data", "citations", "unverified", "schema_errors")
    told = pages.select(F.col("id").alias("seq"), "url", "entities", "triples")
    nodes = graph.nodes(told)
    return {"pages": pages.orderBy("id"), "structured": structured.merge(parts, "job_id", "id"), "nodes": nodes, "edges": graph.edges(told, nodes), "truncated": graph.truncated(told)}


def results_or_archived(live: DataFrame, stored: DataFrame, job_id: str) -> dict[str, DataFrame]:
    """``results`` of a job out of the rows held for running jobs, else out of the stored ones; with ``job``: its id, state
    (``archived`` where only stored rows are left) and first URL.  ``KeyError`` if neither knows the job."""
    own = live.where(F.col("job_id") == job_id)
    known = bool(own.take(1))
    rows = own if known else stored.where(F.col("job_id") == job_id)
    if not known and not rows.take(1):
        raise KeyError(job_id)
    state = F.lit("held" if known else "archived")
    job = rows.groupBy("job_id").agg(F.min_by("url", "id").alias("url")).select("job_id", state.alias("status"), "url")
    return results(rows, job_id) | {"job": job}


def to_ask(prompts: DataFrame, cache: DataFrame, provider: str, base_url: str, model: str, temperature: float = 0.0) -> DataFrame:
    """Prompts (column ``prompt``) that the cache (``key, reply``) has no reply for, each once, with their ``key``."""
    key = cache_key(F.lit(provider), F.lit(base_url), F.lit(model), F.lit(temperature), F.col("prompt"))
    return prompts.select("prompt", key.alias("key")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def cacheable(replies: DataFrame) -> DataFrame:
    """Knowledge replies that are worth keeping: those with an entity or a relation."""
    return replies.where((F.size("entities") > 0) | (F.size("triples") > 0))


def structured_json(result: DataFrame) -> str:
    """The one merged result as JSON text; an absent one is empty."""
    row = result.first()
    found = {"data": {}, "citations": {}, "unverified": [], "schema_errors": []}
    if row is not None:
        plain = row.asDict(recursive=True)
        found = {k: plain[k] for k in found} | {"data": json.loads(plain["data"])}
    return json.dumps(found, ensure_ascii=False)
