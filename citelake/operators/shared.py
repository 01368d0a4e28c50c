"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Scratch folders of each session that are still there.
_FOLDERS: weakref.WeakKeyDictionary[SparkSession, set[str]] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder if all executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="citelake-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete the scratch folders of ``spark``; called before it stops and when the driver ends."""
    folders = _FOLDERS.pop(spark, set())
    if spark.sparkContext._jsc is not None:
        for path in folders:
            remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new scratch folder, which goes when the session is stopped, at the latest when the driver ends."""
    if spark not in _FOLDERS:
        _FOLDERS[spark] = set()
        stop = spark.stop

        def swept() -> None:
            try:
                sweep(spark)
            finally:
                stop()

        spark.stop = swept
        atexit.register(sweep, spark)
    path = f"{shared_folder(spark)}/citelake/{name}-{uuid.uuid4().hex}"
    _FOLDERS[spark].add(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back; a lost executor loses nothing of it."""
    pieces = Pieces(rows.sparkSession, name, rows.schema)
    pieces.add(rows)
    return pieces.table()


class Pieces:
    """A scratch table that is written piece by piece."""

    def __init__(self, spark: SparkSession, name: str, schema):
        self.spark, self.schema, self.path, self.count = spark, schema, scratch(spark, name), 0

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{self.count}")
        self.count += 1

    def table(self) -> DataFrame:
        """All pieces so far; without one, an empty table."""
        if not self.count:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in range(self.count)])
