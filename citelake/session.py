"""Session settings that the operators assume, and the package's typed settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def session(app: str = "citelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``_`` for ``.`` only through a dict."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """Defaults of the page pipeline; ``from_environment`` reads ``CITELAKE_<NAME>`` and keeps the default on bad input."""

    dedup_threshold: float = 0.85
    dedup_least_chars: int = 40
    shingle: int = 5
    chunk_words: int = 180
    chunk_overlap: int = 30
    vector_width: int = 384
    batch: int = 64
    window_tokens: int = 6000
    windows: int = 4
    most_entities: int = 40
    most_triples: int = 60
    most_pages: int = 50
    most_depth: int = 5
    retries: int = 3
    graph_nodes: int = 300
    search_limit: int = 5
    neighbours: int = 25
    jobs_kept: int = 200

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Settings:
        given = os.environ if environment is None else environment
        out = {}
        for field in fields(cls):
            kind = type(field.default)
            try:
                value = kind(given.get(f"CITELAKE_{field.name.upper()}", ""))
            except ValueError:
                continue
            if value > 0:
                out[field.name] = value
        return cls(**out)
