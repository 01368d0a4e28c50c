"""API intelligence over captured traffic."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.functions import jsonx
from citelake.functions.text import is_document, is_static_asset
from citelake.operators.files import write_text


def match_responses(events: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """Responses (``kind = 'response'``) with ``request_seq``: the latest earlier request of the same key, if any.

    An as-of join by window: requests and responses of a key stand in one order and the last request is carried on.
    """
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("kind") == "request", F.col(seq)), ignorenulls=True).over(before)
    return events.withColumn("request_seq", carried).where("kind = 'response'")


def api_calls(calls: DataFrame, url: str = "url") -> DataFrame:
    """Calls that are neither static assets nor, where the content type is known, documents."""
    kept = calls.where(~is_static_asset(F.col(url)))
    return kept.where(~is_document(F.col("content_type"))) if "content_type" in calls.columns else kept


def schemas(rows: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """``keys, schema``: one JSON Schema for all samples of a key.

    Samples are inferred and merged batch by batch before they are shuffled, so a key's samples never meet in one task.
    """

    def fold(texts) -> dict:
        merged: dict | None = None
        for text in texts:
            merged = jsonx.merge_schemas(merged, json.loads(text))
        return merged or {}

    def infer(batches):
        for batch in batches:
            batch = batch.assign(_s=batch["_json"].map(lambda t: json.dumps(jsonx.infer_text(t))))
            grouped = batch.groupby(list(keys), dropna=False)["_s"] if keys else None
            if grouped is None:
                yield pd.DataFrame({"schema": [json.dumps(fold(batch["_s"].unique()))]}) if len(batch) else pd.DataFrame({"schema": []})
            else:
                yield grouped.agg(lambda s: json.dumps(fold(s.unique()))).rename("schema").reset_index()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    partial = rows.select(*keys, F.col(json_col).alias("_json")).mapInPandas(infer, f"{kinds + ', ' if kinds else ''}schema string")

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        merged = json.dumps(fold(sorted(group["schema"].unique())), sort_keys=True)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "schema": merged}])

    distinct = partial.distinct()
    if not keys:
        return distinct.groupBy(F.lit(1)).applyInPandas(lambda g: finish(g)[["schema"]], "schema string")
    return distinct.groupBy(*keys).applyInPandas(finish, f"{kinds}, schema string")


def openapi_operations(calls: DataFrame, skip_documents: bool = True) -> DataFrame:
    """``path, method, operation`` of captured calls (``seq, method, host, path, content_type, request, response``): of
    equal path and method the last call counts."""
    kept = calls.where(~is_document(F.col("content_type"))) if skip_documents else calls
    last = kept.groupBy("path", F.lower("method").alias("verb")).agg(F.max_by(F.struct("method", "host", "request", "response"), "seq").alias("c"))

    @F.pandas_udf("string")
    def operation(method: pd.Series, host: pd.Series, request: pd.Series, response: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(jsonx.openapi_operation(*row), sort_keys=True) for row in zip(method, host, request, response, strict=True)])

    return last.select("path", F.col("verb").alias("method"), operation("c.method", "c.host", "c.request", "c.response").alias("operation"))


def write_openapi(operations: DataFrame, title: str, path: str, version: str = "1.0.0") -> None:
    """The description as one file."""
    write_text(operations.sparkSession.createDataFrame([(openapi_document(operations, title, version),)], "value string"), path)


def openapi_document(operations: DataFrame, title: str, version: str = "1.0.0") -> str:
    """The description as JSON text; it holds one entry for each distinct endpoint of one site."""
    rows = operations.orderBy("path", "method").toLocalIterator()
    return json.dumps(jsonx.openapi_document([(r["path"], r["method"], json.loads(r["operation"])) for r in rows], title, version), indent=2)


def health_reports(probes: DataFrame) -> DataFrame:
    """Probes (``api_id, status_code, latency_ms, error, timed_out``) classified: up below 500, a timeout is 408 and
    down, another error 0 and down with its message."""
    code = F.when(F.col("timed_out"), 408).when(F.col("error").isNotNull(), 0).otherwise(F.col("status_code"))
    up = ~F.col("timed_out") & F.col("error").isNull() & (F.col("status_code") < 500)
    return probes.select("api_id", code.alias("status_code"), F.coalesce(up, F.lit(False)).alias("is_up"), "latency_ms", F.col("error").alias("error_message"))


def health_rows(reports: DataFrame) -> DataFrame:
    """Probe reports (``api_id, url`` and any of ``api_name, status_code, latency_ms, is_up, error_message, checked_at``) as rows to append.

    Numbers that are missing or cannot be read are 0, a missing state is down, blank names and messages are null.
    """
    has = lambda c, kind: F.col(c).cast("string") if c in reports.columns else F.lit(None).cast(kind)
    whole = lambda c: F.coalesce(has(c, "string").try_cast("double").cast("int"), F.lit(0)).alias(c)
    text = lambda c: F.nullif(has(c, "string"), F.lit("")).alias(c)
    up = F.coalesce(has("is_up", "string").try_cast("boolean"), F.lit(False)).alias("is_up")
    at = F.col("checked_at").cast("timestamp") if "checked_at" in reports.columns else F.current_timestamp()
    return reports.select("api_id", text("api_name"), "url", whole("status_code"), whole("latency_ms"), up, text("error_message"), at.alias("checked_at"))


def health_rollup(checks: DataFrame, *keys: str) -> DataFrame:
    """Availability and latency of each key: ``checks, availability, p50_ms, p95_ms``."""
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checks"),
        F.round(F.avg(F.col("is_up").cast("int")), 6).alias("availability"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").cast("int").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("int").alias("p95_ms"),
    )


def session_scores(events: DataFrame, session: str, failed) -> DataFrame:
    """``session, successes, errors, score``: the share of successes, 1 where nothing happened yet."""
    counted = events.groupBy(session).agg(F.count_if(~failed).alias("successes"), F.count_if(failed).alias("errors"))
    total = F.col("successes") + F.col("errors")
    return counted.withColumn("score", F.when(total == 0, 1.0).otherwise(F.round(F.col("successes") / total, 6)))


def healthy_sessions(sessions: DataFrame, most: int = 50, most_errors: int = 5, id_col: str = "session_id") -> DataFrame:
    """Sessions below the error limit, the ``most`` best by score (ties by id)."""
    total = F.col("success_count") + F.col("error_count")
    scored = sessions.withColumn("score", F.when(total == 0, 1.0).otherwise(F.col("success_count") / total))
    return scored.where(F.col("error_count") < most_errors).orderBy(F.desc("score"), id_col).limit(most)
