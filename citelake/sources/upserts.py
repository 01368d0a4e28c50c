"""Keyed writes: the state that a sequence of inserts, updates and deletes leaves, as a table to write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from citelake.functions.text import point_id, sample_value
from citelake.operators.shared import written
from citelake.schemas import EXTRACTION_RESULTS
from citelake.sources.keyed import KeyedTable


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order`` (last write wins).

    An aggregation, not a window: rows of a key are combined before they are shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``stored`` with ``incoming`` merged in by key."""
    return latest(stored.unionByName(incoming, allowMissingColumns=True), keys, order)


def upsert_pages(stored: DataFrame, incoming: DataFrame, order: str = "crawled_at") -> DataFrame:
    """Stored pages (``id, url_hash`` and more) with ``incoming`` (the same columns without ``id``) merged in by URL hash.

    The last write of a hash decides every column but the id, which stays what it was; new hashes get the ids after the
    largest one, in order of their first write.  Rows without a hash go; columns that ``incoming`` lacks become null.
    """
    rest = [c for c in stored.columns if c != "id"]
    fresh = latest(incoming.where("url_hash is not null"), ["url_hash"], order)
    fresh = stored.select(*rest).limit(0).unionByName(fresh, allowMissingColumns=True).select(*rest)
    held = stored.select(F.col("id"), F.col("url_hash").alias("_held"))
    known = fresh.join(held, F.col("url_hash") == F.col("_held")).select("id", *rest)
    kept = stored.join(fresh.select("url_hash"), "url_hash", "left_anti").select("id", *rest)
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    begun = incoming.groupBy(F.col("url_hash").alias("_h")).agg(F.min(order).alias("_first"))
    new = fresh.join(stored.select("url_hash"), "url_hash", "left_anti").join(begun, F.col("url_hash") == F.col("_h"))
    new = numbered(new, "id", "_first", "url_hash").withColumn("id", F.col("id") + F.lit(top)).select("id", *rest)
    return kept.unionByName(known).unionByName(new)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their number from 1 on by ``order`` in a column ``name``.

    Ranges of the order are numbered each by themselves; only their sizes, one row a range, meet in one task.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def update_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """``sessions`` with the cookies and headers of ``changes`` (``session_id, seq, cookies, headers``), the last of each id;
    changes of sessions that are not there do nothing."""
    last = changes.groupBy(F.col("session_id").alias("_id")).agg(F.max_by(F.struct("cookies", "headers"), "seq").alias("_new"))
    joined = sessions.join(last, F.col("session_id") == F.col("_id"), "left")
    new = {c: F.when(F.col("_id").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in ("cookies", "headers")}
    return joined.select(*[new.get(c, F.col(c)) for c in sessions.columns])


def delete(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return stored.join(keys.select(*on).distinct(), on, "left_anti")


def overwrite(rows: DataFrame, base: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version below ``base`` and return its path; readers switch to it when it is whole."""
    path = f"{base}/v-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(path)
    return path


def seen_apis(calls: DataFrame) -> DataFrame:
    """Calls (``seq, ts, method, url, content_type, request, response``) as one row per method and URL.

    Host, path and first time come from the first call, samples and content type from the last; rows without a URL go.
    """
    named = calls.where(F.trim("url") != "").withColumn("method", F.upper("method"))
    return named.groupBy("method", "url").agg(
        F.min_by(F.call_function("try_parse_url", F.col("url"), F.lit("HOST")), "seq").alias("host"),
        F.min_by(F.call_function("try_parse_url", F.col("url"), F.lit("PATH")), "seq").alias("path"),
        F.max_by("content_type", "seq").alias("content_type"),
        sample_value(F.max_by("request", "seq")).alias("sample_request"),
        sample_value(F.max_by("response", "seq")).alias("sample_response"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
        F.count(F.lit(1)).alias("seen_count"),
    )


def entity_rows(entities: DataFrame) -> DataFrame:
    """Entities to append (``name, entity_type, type, source_url, page_url``): named ones, typed in upper case."""

    def given(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in entities.columns])

    kind = F.upper(F.coalesce(given("entity_type", "type"), F.lit("ENTITY")))
    named = entities.where(F.trim("name") != "")
    return named.select(F.trim("name").alias("name"), kind.alias("entity_type"), given("source_url", "page_url").alias("source_url"))


def result_rows(entries: DataFrame, stored_top: int = 0) -> DataFrame:
    """A job's page entries (``job_id, url`` and any other column of ``EXTRACTION_RESULTS``) as rows to append, numbered after ``stored_top``.

    Only entries with a summary, an entity or structured data are stored.  What is missing is null, for lists empty and for
    ``data`` an empty object; ``created_at`` defaults to now.
    """
    kinds = [f for f in StructType.fromDDL(EXTRACTION_RESULTS) if f.name != "id"]
    empty = {"data": F.lit("{}"), "created_at": F.current_timestamp()}
    cells = []
    for f in kinds:
        none = empty.get(f.name, F.array().cast(f.dataType) if isinstance(f.dataType, ArrayType) else F.create_map().cast(f.dataType) if isinstance(f.dataType, MapType) else F.lit(None).cast(f.dataType))
        cells.append((F.coalesce(F.col(f.name).cast(f.dataType), none) if f.name in entries.columns else none).alias(f.name))
    rows = entries.select(*cells).withColumn("_hash", F.xxhash64("job_id", "url"))
    told = (F.coalesce("summary", F.lit("")) != "") | (F.size("entities") > 0) | (F.col("data") != "{}")
    kept = numbered(rows.where(told), "id", "created_at", "_hash", "url")
    return kept.select((F.col("id") + F.lit(stored_top)).cast("long").alias("id"), *[f.name for f in kinds])


def index_vectors(table: KeyedTable, chunks: DataFrame, width: int, namespace: str) -> int:
    """Write the vectors of pages' chunks (``url, chunk_index, chunk, vector`` and any of ``job_id, title, depth``) and return the version.

    All vectors must have ``width`` elements, else ``ValueError`` before anything is written.  A chunk's id follows from its
    URL and number, so a page that is written again replaces its points.  The table's schema is ``CHUNK_POINT`` and ``at``.
    """
    whole = vector_points(chunks, width)
    names = {"url": "string", "chunk_index": "int", "chunk": "string", "job_id": "string", "title": "string", "depth": "int"}
    payload = F.struct(*[(F.col(c) if c in chunks.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names.items()])
    at = F.col("at") if "at" in chunks.columns else F.lit(0)
    return table.upsert(whole.select(point_id(F.col("url"), F.col("chunk_index"), namespace).alias("id"), F.col("vector").cast("array<float>").alias("vector"), payload.alias("payload"), at.cast("long").alias("at")))


def drop_page_vectors(table: KeyedTable, urls: DataFrame) -> int:
    """Remove the points of pages (``url``) and return the version."""
    points = table.read().select("id", "at", F.col("payload.url").alias("_url"))
    gone = points.join(urls.select(F.trim("url").alias("_u")).distinct(), F.trim("_url") == F.col("_u"), "left_semi")
    return table.delete(gone.select("id", "at"))


def vector_points(rows: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """``rows`` if every vector has ``width`` elements; ``ValueError`` before anything is written otherwise."""
    wrong = rows.where((F.size(vector) != width) | F.col(vector).isNull()).limit(1).count()
    if wrong:
        raise ValueError(f"vectors must have {width} elements")
    return rows
