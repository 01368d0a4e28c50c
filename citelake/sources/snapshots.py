"""Stored page fetches as a Spark data source: the connector slot in which a fetcher would stand.

    register(spark)
    spark.read.format("page_snapshots").option("path", folder).load()
    spark.readStream.format("page_snapshots").option("path", folder).load()

A folder holds numbered folders, one for each round of fetching, with Parquet files of ``url, status, html, error``.  Files are the
partitions; a stream's offset is the number of the last round, and a round is read once it is named complete (a file ``_SUCCESS``, as
Spark's writers leave it).  A fetch that failed is a row with its error and without a page.  Filters for one URL or status reach the files.
The folder is opened by its URI on the executors (local, HDFS, S3 as pyarrow knows them).  With the option ``loose`` set to ``false`` titles
keep character references without a semicolon as they are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from citelake.functions import html

SCHEMA = "url string, round bigint, status int, title string, html string, error string"
DONE = "_SUCCESS"
_STORED = pa.schema([("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string())])


@dataclass
class File(InputPartition):
    path: str
    round: int


def rounds(folder: str) -> dict[int, list[str]]:
    """The complete rounds below a folder and their files."""
    system, root = fs.FileSystem.from_uri(folder)
    found = {}
    for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if entry.type == fs.FileType.Directory and entry.base_name.isdigit():
            names = {f.base_name: f.path for f in system.get_file_info(fs.FileSelector(entry.path))}
            if DONE in names:
                found[int(entry.base_name)] = sorted(path for name, path in names.items() if name.endswith(".parquet"))
    return found


def read_file(folder: str, part: File, equal: dict[str, object], loose: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of a file whose columns equal the given values, in batches."""
    system, _ = fs.FileSystem.from_uri(folder)
    wanted = None
    for column, value in equal.items():
        test = pc.field(column) == pc.scalar(value)
        wanted = test if wanted is None else wanted & test
    for batch in ds.dataset(part.path, schema=_STORED, filesystem=system, format="parquet").to_batches(filter=wanted, batch_size=256):
        if batch.num_rows:
            # not by pc.if_else: over slices of a column it can give texts cut at other places
            pages = [page if error is None else None for page, error in zip(batch["html"].to_pylist(), batch["error"].to_pylist(), strict=True)]
            titles = [None if page is None else html.title(page, loose) for page in pages]
            yield pa.RecordBatch.from_arrays(
                [batch["url"], pa.array([part.round] * batch.num_rows, pa.int64()), batch["status"], pa.array(titles, pa.string()), pa.array(pages, pa.string()), batch["error"]],
                names=["url", "round", "status", "title", "html", "error"],
            )


class _Batch(DataSourceReader):
    def __init__(self, folder: str, loose: bool):
        self.folder, self.loose = folder, loose
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Take filters for one URL or status; give back the others."""
        for given in filters:
            if isinstance(given, EqualTo) and len(given.attribute) == 1 and given.attribute[0] in ("url", "status") and given.attribute[0] not in self.equal:
                self.equal[given.attribute[0]] = given.value
            else:
                yield given

    def partitions(self) -> list[File]:
        return [File(path, number) for number, files in sorted(rounds(self.folder).items()) for path in files]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(self.folder, partition, self.equal, self.loose) if isinstance(partition, File) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, loose: bool):
        self.folder, self.loose = folder, loose

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last complete round; rounds are fetched one after the other, so the ones before it are complete too."""
        return {"round": max(rounds(self.folder), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(path, number) for number, files in sorted(rounds(self.folder).items()) if start["round"] < number <= end["round"] for path in files]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(self.folder, partition, {}, self.loose)


class PageSnapshots(DataSource):
    """The source ``page_snapshots``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "page_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("page_snapshots needs the option path")
        return self.options["path"]

    def _loose(self) -> bool:
        return self.options.get("loose", "true").lower() != "false"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._folder(), self._loose())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self._folder(), self._loose())


def register(spark: SparkSession) -> None:
    """Let ``spark`` read the source and give it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSnapshots)
