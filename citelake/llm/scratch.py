"""Shared-folder scratch tables that cut lineage and survive lost executors.

Every multi-pass operator of this subpackage writes its intermediate tables here as Parquet, below the
folder that the cluster names in ``spark.checkpoint.dir``.  A written table does not depend on any
executor's local disk, so a lost executor costs a task retry and never a failed job.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from citelake.operators.shared import remove, scratch

#: Seconds that listeners may take to hear of a written table.
TOLD_S = 0.3


class Scratch:
    """A set of written tables of one operator call; they are removed when the session is stopped, at the latest when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = scratch(spark, tag)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` once and return the written table."""
        path = f"{self.base}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def release(self) -> None:
        """Let the driver forget the plans of tables that are written, so that executors delete their shuffle files.

        Spark's cleaner deletes a shuffle's files once the driver's garbage collector has found its plan
        unreachable, by itself every half hour; a job of many passes would hold the files of all of them.  The plan of the last
        table stays reachable until Spark's listeners have been told that it is written, so this waits for a moment.
        """
        time.sleep(TOLD_S)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.base}/{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_buckets(spark: SparkSession, rows: int, rows_per_bucket: int = 50_000) -> int:
    """How many ranges a uniform hash is cut into, so that none holds much more than ``rows_per_bucket``."""
    return max(1, -(-rows // rows_per_bucket), shuffle_partitions(spark))
