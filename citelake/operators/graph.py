"""The knowledge graph: nodes and edges out of pages' entities and relations, neighbours and counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from citelake.functions.text import IDENTIFIER, relationship_type

NODE_CAP = 300
NEIGHBOURS = 25
NAME_CHARS = 200


@F.pandas_udf(StringType())
def folded(name: pd.Series) -> pd.Series:
    """Stripped and case-folded, as names are compared: ``Straße`` is ``STRASSE``."""
    return name.str.strip().str.casefold()


def mentions(pages: DataFrame) -> DataFrame:
    """Names in the order in which pages (``seq, url, entities, triples``) give them: ``key, label, entity_type, at``.

    A page's entities come first, then subject and object of each relation; those take the type that the page's own
    entities give the name.
    """
    entities = pages.select("seq", F.posexplode("entities").alias("n", "e")).select(
        "seq", F.lit(0).alias("kind"), F.col("n"), F.lit(0).alias("part"), F.trim("e.name").alias("label"),
        F.upper(F.coalesce(F.nullif(F.trim("e.type"), F.lit("")), F.lit("ENTITY"))).alias("entity_type"),
    )
    typed = entities.groupBy("seq", folded(F.col("label")).alias("key")).agg(F.max_by("entity_type", "n").alias("page_type"))
    ends = pages.select("seq", F.posexplode("triples").alias("n", "t")).select("seq", "n", F.posexplode(F.array("t.subject", "t.object")).alias("part", "label"))
    ends = ends.select("seq", F.lit(1).alias("kind"), "n", "part", F.trim("label").alias("label"))
    ends = ends.withColumn("key", folded(F.col("label"))).join(typed, ["seq", "key"], "left")
    ends = ends.select("seq", "kind", "n", "part", "label", F.coalesce("page_type", F.lit("ENTITY")).alias("entity_type"))
    both = entities.unionByName(ends).withColumn("key", folded(F.col("label"))).where("key <> ''")
    return both.select("key", "label", "entity_type", F.struct("seq", "kind", "n", "part").alias("at"))


def nodes(pages: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """``key, id, label, type`` of the first ``cap`` names, with the first spelling and the first type that says something."""
    told = F.when(F.col("entity_type") != "ENTITY", F.col("entity_type"))
    found = mentions(pages).groupBy("key").agg(
        F.min("at").alias("at"), F.min_by("label", "at").alias("label"), F.min_by(told, F.when(told.isNotNull(), F.col("at"))).alias("type")
    )
    first = found.orderBy("at").limit(cap)  # a top-k: every task keeps ``cap`` rows
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("at")) - 1)
    return numbered.select("key", F.concat(F.lit("n"), "n").alias("id"), F.substring("label", 1, NAME_CHARS).alias("label"), F.coalesce("type", F.lit("ENTITY")).alias("type"))


def edges(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``source, target, type, source_url``: relations between nodes, each once with its first spelling and page."""
    flat = pages.select("seq", "url", F.posexplode("triples").alias("n", "t"))
    keys = flat.select(
        folded(F.col("t.subject")).alias("s"), folded(F.col("t.object")).alias("o"), F.trim("t.predicate").alias("p"), "url", F.struct("seq", "n").alias("at")
    ).where("p <> ''")
    once = keys.groupBy("s", "o", F.upper("p").alias("P")).agg(F.min_by("p", "at").alias("type"), F.min_by("url", "at").alias("source_url"))
    source, target = found.select(F.col("key").alias("s"), F.col("id").alias("source")), found.select(F.col("key").alias("o"), F.col("id").alias("target"))
    return once.join(source, "s").join(target, "o").select("source", "target", "type", "source_url")


def truncated(pages: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """``truncated``: whether there are more names than ``cap``."""
    return mentions(pages).select("key").distinct().limit(cap + 1).agg((F.count(F.lit(1)) > cap).alias("truncated"))


def store_edges(triples: DataFrame) -> DataFrame:
    """Relations (``subject, predicate, object, at``, optional ``props``) as stored: nodes by exact name, predicates as
    relationship types; the last one's properties stay.  Predicates that are no identifiers go."""
    typed = triples.withColumn("rel", relationship_type(F.col("predicate"))).where("rel is not null and trim(subject) <> '' and trim(object) <> ''")
    props = F.max_by("props", "at").alias("props") if "props" in triples.columns else F.lit(None).cast("map<string,string>").alias("props")
    return typed.groupBy("subject", "rel", "object").agg(F.min("at").alias("created"), F.max("at").alias("updated"), props)


def page_nodes(pages: DataFrame) -> DataFrame:
    """Pages (``url, title, at``, optional ``job_id`` and ``metadata``) as stored nodes: ``url, title, job_id, first_at, last_at, props``.

    The last write decides title and job, blank ones being none; of the metadata the last value given for each name stays, names
    that are no identifiers and values that are null change nothing.  Rows without a URL go; a repeated URL is one node.
    """
    named = pages.where("trim(url) <> ''")
    given = {c: F.nullif(F.col(c), F.lit("")) if c in pages.columns else F.lit(None).cast("string") for c in ("title", "job_id")}
    last = named.groupBy("url").agg(*[F.max_by(x, "at").alias(c) for c, x in given.items()], F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    if "metadata" not in pages.columns:
        return last.withColumn("props", F.create_map().cast("map<string,string>"))
    told = named.select(F.col("url").alias("_url"), "at", F.explode("metadata").alias("name", "value")).where(F.col("value").isNotNull() & F.col("name").rlike(IDENTIFIER))
    kept = told.groupBy("_url", "name").agg(F.max_by("value", "at").alias("value"))
    props = kept.groupBy("_url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_props"))
    joined = last.join(props, F.col("url") == F.col("_url"), "left")
    return joined.select(*last.columns, F.coalesce("_props", F.create_map().cast("map<string,string>")).alias("props"))


def mention_edges(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored entities and the pages that mention them, out of pages' entities (``url, entities, at``).

    Entities: ``name, type, first_at, last_at`` by exact trimmed name, the last type given stays.  Where ``pages`` have a ``place``
    (and ``at`` is a number), the first by it stays of pages of one time.  Edges: ``url, name, mentions, last_at``, one for each page
    and entity however often the page was stored.
    """
    placed = "place" in pages.columns
    rows = pages.where("trim(url) <> ''").select("url", "at", (F.col("place") if placed else F.lit(0)).alias("place"), F.posexplode("entities").alias("n", "e"))
    rows = rows.select("url", "at", "place", "n", F.trim("e.name").alias("name"), F.upper(F.coalesce(F.nullif(F.trim("e.type"), F.lit("")), F.lit("ENTITY"))).alias("type")).where("name <> ''")
    entities = rows.groupBy("name").agg((F.min_by("type", F.struct(-F.col("at"), "place", -F.col("n"))) if placed else F.max_by("type", F.struct("at", "n"))).alias("type"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    edge_rows = rows.groupBy("url", "name").agg(F.count_distinct("at").alias("mentions"), F.max("at").alias("last_at"))
    return entities, edge_rows


def neighbours(edge_rows: DataFrame, key: str, limit: int = NEIGHBOURS) -> DataFrame:
    """Nodes one step from ``key`` in either direction, with the relation."""
    out = edge_rows.where(F.col("src") == key).select("rel", F.col("dst").alias("neighbour"))
    back = edge_rows.where(F.col("dst") == key).select("rel", F.col("src").alias("neighbour"))
    return out.unionByName(back).orderBy("rel", "neighbour").limit(limit)


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """``nodes, relationships``; nodes are counted even where there is no relationship."""
    return node_rows.agg(F.count(F.lit(1)).alias("nodes")).join(edge_rows.agg(F.count(F.lit(1)).alias("relationships")))


def entities_by_pages(entity_rows: DataFrame) -> DataFrame:
    """Entities (``name, type, url, at``) by the number of pages that name them: ``key, name, type, pages``."""
    named = entity_rows.where(F.trim("name") != "").groupBy(F.trim("name").alias("name"), "url").agg(F.min(F.struct("at", "type")).alias("first"))
    keys = named.select(F.col("name").alias("_name")).distinct().withColumn("key", folded(F.col("_name")))  # each spelling is folded once
    found = named.join(keys, F.col("name") == F.col("_name")).groupBy("key").agg(
        F.min_by("name", "first.at").alias("name"), F.min_by("first.type", "first.at").alias("type"), F.count_distinct("url").alias("pages")
    )
    return found.orderBy(F.desc("pages"), "name")
