"""The crawl frontier over stored pages: links, robots rules, breadth-first expansion and the request queue's states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions import html
from citelake.functions.robots import rules_for
from citelake.operators.shared import written

MOST_DEPTH = 5
RETRIES = 3
AGENT = "CitelakeBot"


def link_table(pages: DataFrame, same_host: bool = True) -> DataFrame:
    """``url, position, link`` for pages (``url, html``): each page's links in document order."""

    @F.pandas_udf("array<string>")
    def found(urls: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([html.links(h, u, same_host) for u, h in zip(urls, sources, strict=True)])

    return pages.select("url", F.posexplode(found("url", "html")).alias("position", "link"))


def robots_rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """``host, position, allow, path`` of the rules that hold for ``agent`` on each host, out of its robots text (``host, text``).

    Only the texts, one a host, are parsed; whether a link may be fetched is then a comparison with these rows.
    """

    @F.pandas_udf("array<struct<allow:boolean,path:string>>")
    def rules(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [{"allow": allow, "path": path} for allow, path in rules_for(text or "", agent)])

    return robots.select("host", F.posexplode(rules("text")).alias("position", "rule")).select("host", "position", "rule.allow", "rule.path")


def allowed(links: DataFrame, robots: DataFrame, agent: str = AGENT, link_col: str = "link") -> DataFrame:
    """Links that their host's robots text (``host, text``) lets ``agent`` fetch; hosts without one allow all.

    The first rule whose path the link's path begins with decides; where there is none the link is allowed.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "allow", "path"))), lambda r: F.struct(r["allow"].alias("allow"), r["path"].alias("path")))
    by_host = robots_rules(robots, agent).groupBy(F.col("host").alias("_host")).agg(listed.alias("_rules"))
    part = lambda what: F.call_function("try_parse_url", F.col(link_col), F.lit(what))
    query = F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit(""))
    raw = F.concat(F.coalesce(part("PATH"), F.lit("")), query)
    plain = F.coalesce(F.call_function("try_url_decode", F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    joined = links.join(by_host, part("AUTHORITY") == F.col("_host"), "left").withColumn("_path", F.when(plain == "", "/").otherwise(plain))
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"])), F.lit(0))
    return joined.where(F.coalesce(first["allow"], F.lit(True))).drop("_host", "_rules", "_path")


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int = MOST_DEPTH) -> DataFrame:
    """``node, depth``: what ``max_depth`` steps along ``edges`` (``src, dst``) reach from ``seeds`` (``node``), each at
    its least depth.  A level is a join and an anti-join with what was seen; levels are written, so lineage stays flat."""
    level = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = level
    for depth in range(1, max_depth + 1):
        reached = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        level = written(fresh, "frontier")
        if not level.take(1):
            break
        seen = seen.union(level)
    return seen


def within_cap(frontier: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` nodes in visit order (depth, then ``order``): a top-k, so no task holds them all."""
    return frontier.orderBy("depth", *order).limit(cap)


def queue_states(events: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Requests (``url, seq, event, depth, max_depth`` with event add, fail or complete) as ``url, status, retries``.

    A request deeper than its limit is not queued; one that failed more than ``retries`` times is dropped.
    """
    added = events.where("event <> 'add' or depth <= max_depth")
    state = added.groupBy("url").agg(
        F.max_by("event", "seq").alias("last"),
        F.count_if(F.col("event") == "fail").alias("failures"),
        F.max(F.when(F.col("event") == "complete", 1).otherwise(0)).alias("done"),
        F.max(F.when(F.col("event") == "add", 1).otherwise(0)).alias("queued"),
    )
    status = F.when(F.col("done") == 1, "completed").when(F.col("failures") > retries, "dropped").otherwise("queued")
    return state.where("queued = 1").select("url", status.alias("status"), F.least(F.col("failures"), F.lit(retries)).alias("retries"))


def visits(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Attempts (``url, attempt, outcome``: ``ok``, ``timeout`` of the page's handler, or anything else for a page that did not
    open) as ``url, status, retries``.

    A page that did not open is tried again, up to ``retries`` times.  A handler that took too long is not: its work is done and
    counted, so the request is complete.  Attempts after the one that decided do not count.
    """
    ended = F.col("outcome").isin("ok", "timeout")
    told = attempts.groupBy("url").agg(F.min(F.when(ended, F.col("attempt"))).alias("_end"))
    told = attempts.join(told.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url")).groupBy("url", "_end").agg(
        F.count_if(~ended & (F.col("_end").isNull() | (F.col("attempt") < F.col("_end")))).alias("failures")
    )
    status = F.when(F.col("failures") > retries, "dropped").when(F.col("_end").isNotNull(), "completed").otherwise("queued")
    return told.select("url", status.alias("status"), F.least(F.col("failures"), F.lit(retries)).alias("retries"))


def expired(locked: DataFrame, now: float, lease_seconds: float) -> DataFrame:
    """Requests whose lock is older than the lease: they go back to the queue, unlocked."""
    return locked.where(F.lit(now) - F.col("lock_time") > lease_seconds).withColumn("lock_time", F.lit(None).cast("double"))
