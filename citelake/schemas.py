"""Schemas of the stored entities, as Spark DDL."""

from __future__ import annotations

CRAWL_REQUEST = "url STRING, depth INT, max_depth INT, payload MAP<STRING,STRING>, unique_key STRING, lock_time DOUBLE"
CRAWLED_PAGES = (
    "id BIGINT, url STRING, url_hash STRING, job_id STRING, title STRING, html STRING, markdown STRING, chunk_count INT, status_code INT,"
    " depth INT, content_hash STRING, crawled_at TIMESTAMP"
)
EXTRACTED_ENTITIES = "id BIGINT, page_id BIGINT, name STRING, entity_type STRING, source_url STRING, properties STRING, created_at TIMESTAMP"
API_HEALTH_CHECKS = (
    "api_id STRING, api_name STRING, url STRING, status_code INT, latency_ms INT, is_up BOOLEAN, error_message STRING, checked_at TIMESTAMP"
)
DISCOVERED_APIS = (
    "method STRING, url STRING, host STRING, path STRING, content_type STRING, sample_request STRING, sample_response STRING,"
    " first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, seen_count INT"
)
QUOTE = "STRUCT<quote:STRING,url:STRING>"
ENTITY = "STRUCT<name:STRING,type:STRING>"
TRIPLE = "STRUCT<subject:STRING,predicate:STRING,object:STRING>"
KNOWLEDGE = f"entities ARRAY<{ENTITY}>, triples ARRAY<{TRIPLE}>, topics ARRAY<STRING>, summary STRING"
STRUCTURED = f"data STRING, citations MAP<STRING,ARRAY<{QUOTE}>>, unverified ARRAY<STRING>, schema_errors ARRAY<STRING>"
EXTRACTION_RESULTS = f"id BIGINT, job_id STRING, url STRING, title STRING, status_code INT, {KNOWLEDGE}, {STRUCTURED}, model STRING, created_at TIMESTAMP"
CHUNK_POINT = "id STRING, vector ARRAY<FLOAT>, payload STRUCT<url:STRING,chunk_index:INT,chunk:STRING,job_id:STRING,title:STRING,depth:INT>"
NODES = "label STRING, key STRING, name STRING, entity_type STRING, props MAP<STRING,STRING>, created_at TIMESTAMP"
EDGES = "src_label STRING, src_key STRING, rel STRING, dst_label STRING, dst_key STRING, props MAP<STRING,STRING>, updated_at TIMESTAMP"
PROGRESS_EVENT = "job_id STRING, seq BIGINT, event STRING, data STRING, ts TIMESTAMP"
CAPTURED_CALL = (
    "seq BIGINT, method STRING, url STRING, host STRING, path STRING, request_payload STRING, response_payload STRING, content_type STRING"
)
CATALOGUE = (
    "id STRING, category STRING, name STRING, base_url STRING, endpoints ARRAY<STRUCT<path:STRING,method:STRING,description:STRING>>,"
    " auth_type STRING, https BOOLEAN, description STRING"
)
SCRAPING_SESSION = "session_id STRING, proxy STRING, cookies STRING, headers MAP<STRING,STRING>, error_count BIGINT, success_count BIGINT"
TABLES = ("crawled_pages", "extracted_entities", "api_health_checks", "discovered_apis", "extraction_results")
