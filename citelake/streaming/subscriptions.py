"""Events of jobs for subscribers that come and go: a snapshot first, then every later event once and in order.

Events stand in an append-only table and bear a number within their job.  A subscriber is a row that says up to which number it was
told; a delivery is a join of the two, so a subscriber that reconnects goes on where it was, and nothing is held for those who are away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.operators.shared import written
from citelake.sources.keyed import KeyedTable

#: Events that a subscriber may be behind.
BACKLOG = 1000
SCHEMA = "subscriber string, job_id string, upto bigint, state string, turn bigint"
OPEN, DONE, DROPPED = "open", "done", "dropped"
SNAPSHOT = "snapshot"


def subscriptions(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """A new table of subscriptions."""
    return KeyedTable.create(spark, path, SCHEMA, ["subscriber", "job_id"], ["turn"], buckets)


def subscribe(table: KeyedTable, who: DataFrame, turn: int) -> int:
    """Add subscriptions (``subscriber, job_id``) as of delivery ``turn``; the first delivery gives them a snapshot."""
    return table.upsert(who.select("subscriber", "job_id", F.lit(None).cast("long").alias("upto"), F.lit(OPEN).alias("state"), F.lit(turn).alias("turn")))


def due(events: DataFrame, held: DataFrame, turn: int, backlog: int = BACKLOG, last: str = DONE) -> tuple[DataFrame, DataFrame]:
    """What to tell now (``subscriber, job_id, place, seq, event, data``) and the subscriptions afterwards.

    ``events`` are ``job_id, seq, event, data``, numbered without gaps or with; ``place`` orders what a subscriber is told of a job.
    A new subscription gets one snapshot (the data of the job's last event and its number); it holds all events up to that number, so
    nothing between subscribing and the snapshot is lost or told twice.  Then come the events after the number, up to the job's
    ``last`` event, which ends the subscription.  One that is more than ``backlog`` events behind is told so and dropped.
    """
    asked = held.where(F.col("state") == OPEN).select("subscriber", F.col("job_id").alias("_job"), "upto")
    later = asked.join(events, F.col("_job") == F.col("job_id")).where(F.col("upto").isNull() | (F.col("seq") > F.col("upto")))
    ended = F.min(F.when(F.col("event") == last, F.col("seq")))
    sizes = later.groupBy("subscriber", "job_id", "upto").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"), F.max_by("data", "seq").alias("data"), ended.alias("end"))
    sizes = written(sizes, "due")
    new, behind = F.col("upto").isNull(), F.col("upto").isNotNull() & (F.col("n") > backlog)
    none = F.lit(None).cast("string")
    # one row for each new, finished or late subscription
    snapshots = sizes.where(new).select("subscriber", "job_id", F.lit(0).alias("place"), F.col("top").alias("seq"), F.lit(SNAPSHOT).alias("event"), "data")
    ends = sizes.where(new & F.col("end").isNotNull()).select("subscriber", "job_id", F.lit(1), F.col("top"), F.lit(last), "data")
    drops = sizes.where(behind).select("subscriber", "job_id", F.lit(0), F.col("upto"), F.lit(DROPPED), F.concat(F.col("n").cast("string"), F.lit(" events behind")))
    going = sizes.where(~new & ~behind).select(F.col("subscriber").alias("_s"), F.col("job_id").alias("_j"), "end")
    told = later.drop("_job").join(going, (F.col("subscriber") == F.col("_s")) & (F.col("job_id") == F.col("_j"))).where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    place = (F.row_number().over(Window.partitionBy("subscriber", "job_id").orderBy("seq")) - 1).cast("int")
    tail = told.select("subscriber", "job_id", place, "seq", "event", F.coalesce("data", none))
    state = F.when(behind, DROPPED).when(F.col("end").isNotNull(), DONE).otherwise(OPEN)
    upto = F.when(behind, F.col("upto")).when(~new & F.col("end").isNotNull(), F.col("end")).otherwise(F.col("top"))
    after = sizes.select("subscriber", "job_id", upto.alias("upto"), state.alias("state"), F.lit(turn).cast("long").alias("turn"))
    return snapshots.union(ends).union(drops).union(tail).toDF("subscriber", "job_id", "place", "seq", "event", "data"), after


def deliver(events: DataFrame, table: KeyedTable, turn: int, backlog: int = BACKLOG, last: str = DONE) -> DataFrame:
    """Tell what is due at delivery ``turn`` and move the subscriptions on.

    The rows are written before the subscriptions move, and subscriptions move at once or not at all.
    """
    told, after = due(events, table.read(), turn, backlog, last)
    told = written(told, "told")
    table.upsert(after, stream="deliveries", batch=turn)
    return told
