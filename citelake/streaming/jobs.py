"""Streaming forms: windows over events, incremental merging, calls and their responses, events of a job, keyed tables as sinks.

Every sink is idempotent by key and batch.  Pages against the newest of their job and the request queue are in
:mod:`citelake.streaming.stateful`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citelake.functions.text import is_static_asset
from citelake.operators.merging import place_rows
from citelake.sources.keyed import KeyedTable

def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """``start, event_type, n, total`` of tumbling windows; rows later than ``late`` are not waited for."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def part_rows(parts: DataFrame) -> DataFrame:
    """Structured parts (``job_id, seq, data, citations, unverified``) as the rows that they merge by.

    Append these to a table: :func:`citelake.operators.merging.merged_values` of all its rows is what each job has so far, whatever
    the order and grouping in which they came.
    """
    return place_rows(parts, "job_id", "seq")


def _attach(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_seq = state.get[0] if state.exists else None
    found = []
    for row in pd.concat(list(batches)).sort_values("seq").itertuples():
        if row.kind == "request":
            open_seq = int(row.seq)
        elif row.kind == "response":
            found.append((key[0], int(row.seq), open_seq, row.content_type, row.body))
    state.update((open_seq,))
    yield pd.DataFrame(found, columns=["url", "seq", "request_seq", "content_type", "body"]).astype({"request_seq": "Int64"})


def captured_calls(events: DataFrame) -> DataFrame:
    """Traffic (``url, seq, kind, content_type, body``) as responses with the number of the latest request of their URL
    before them, if any; a URL's state is that one number.  Static assets are left out."""
    kept = events.where(~is_static_asset(F.col("url")))
    return kept.groupBy("url").applyInPandasWithState(
        _attach, "url string, seq long, request_seq long, content_type string, body string", "request_seq long", "append", GroupStateTimeout.NoTimeout
    )


def progress(events: DataFrame, job_id: str, after: int = -1) -> DataFrame:
    """A job's events that come after number ``after``, each told once."""
    return events.where((F.col("job_id") == job_id) & (F.col("seq") > after))


def publish(stream: DataFrame, table: KeyedTable, checkpoint: str, most: int = 4):
    """Start writing ``stream`` to a table of one row a key, the newest by the table's order.

    A micro-batch writes its own rows only, and one that is told again (by its number, under the identity that Spark gives the
    checkpoint) does nothing; a new checkpoint continues with what the table holds.  Buckets of more than ``most`` files are merged.
    """

    def write(batch: DataFrame, number: int) -> None:
        told = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"]
        table.upsert(batch, stream=json.loads(told)["id"], batch=number)
        table.compact(most)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
