"""Small text results written where the cluster's file systems are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_text(value: DataFrame, path: str) -> None:
    """One row's only column as one file at ``path``, in any file system that Spark reaches; the text must fit the driver."""
    row = value.first()
    text = "" if row is None or row[0] is None else row[0]
    session = value.sparkSession
    jvm, conf = session._jvm, session._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
