"""Tables of one row a key that are changed by writing what changes.

Rows live in buckets of their key's hash.  A change writes its rows, and nothing else, as new files of the buckets they fall in; a
deletion writes rows that say so.  The manifest, one small file a version, lists the files of each bucket; a change counts once its
manifest is renamed into place, which happens at once or not at all.  So readers keep the version they opened, two writers that meet
both count (the second one reads the newer manifest and tries again), and a writer that dies leaves files that nobody lists.
A bucket of a single merged file is read as it is; in others the last row of each key counts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citelake.operators.shared import remove

#: Columns of the files beside the table's own.
BUCKET, GONE, CHANGE = "_bucket", "_gone", "_change"
TRIES = 20


@dataclass(frozen=True)
class Manifest:
    """A version: its files by bucket, oldest first, and what each stream has written so far."""

    version: int
    schema: str
    keys: list[str]
    order: list[str]
    buckets: int
    files: dict[str, list[str]] = field(default_factory=dict)
    merged: list[str] = field(default_factory=list)  # buckets whose first file holds each key once and no deletion
    done: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """The table below ``path``.  ``order`` columns tell which of two rows of a key is later; of equal ones the later change counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 64) -> KeyedTable:
        """A new empty table; ``FileExistsError`` where there is one."""
        table = cls(spark, path)
        if not table._commit(Manifest(0, schema, keys, order, buckets)):
            raise FileExistsError(path)
        return table

    # --- files ------------------------------------------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The versions whose manifests are kept, oldest first."""
        where = self._at("manifests")
        files = where.getFileSystem(self._conf)
        found = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(name[:-5]) for name in found if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, of the last one if none is named."""
        if version is None:
            version = self.versions()[-1]
        where = self._at(f"manifests/{version:012}.json")
        stream = where.getFileSystem(self._conf).open(where)
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> bool:
        """Put a version into place; whether it was still free."""
        draft, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{manifest.version:012}.json")
        files = draft.getFileSystem(self._conf)
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        uri = draft.getFileSystem(self._conf).getUri()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # refuses to rename onto what is there
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(draft, final, options)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- changes ----------------------------------------------------------------------------------------

    def _bucket(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(t) for k, t in self._types(manifest)]), F.lit(manifest.buckets)).cast("int")

    def _types(self, manifest: Manifest) -> list[tuple[str, str]]:
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(manifest.schema)}
        return [(k, kinds[k]) for k in manifest.keys]

    def _write(self, rows: DataFrame, manifest: Manifest, number: str) -> dict[str, str]:
        """``rows`` as one file for each bucket that they fall in: folder by bucket."""
        folder = f"files/{number}"
        rows.withColumn(BUCKET, self._bucket(manifest)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        where = self._at(folder)
        found = [f.getPath().getName() for f in where.getFileSystem(self._conf).listStatus(where) if f.isDirectory()]
        return {name.partition("=")[2]: f"{folder}/{name}" for name in found}

    def _change(self, rows: DataFrame, gone: bool, stream: str | None, batch: int | None) -> int:
        manifest = self.manifest()
        if stream is not None and manifest.done.get(stream, -1) >= batch:
            return manifest.version
        kinds = StructType.fromDDL(manifest.schema)
        given = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
        # of a change's own rows of a key the last counts, so a key that a third of them bear is one row before it moves
        rest = [f.name for f in kinds if f.name not in manifest.keys]
        last = rows.select(*given).groupBy(*manifest.keys).agg(F.max_by(F.struct(*rest), F.struct(*manifest.order)).alias("_r")) if rest else rows.select(*given).distinct()
        last = last.select(*[F.col(f.name) if f.name in manifest.keys else F.col(f"_r.{f.name}").alias(f.name) for f in kinds])
        new = self._write(last.withColumn(GONE, F.lit(gone)), manifest, uuid.uuid4().hex)
        for _ in range(TRIES):
            files = manifest.files | {b: [*manifest.files.get(b, []), folder] for b, folder in new.items()}
            done = manifest.done | ({stream: batch} if stream is not None else {})
            if self._commit(Manifest(**manifest.__dict__ | {"version": manifest.version + 1, "files": files, "done": done})):
                return manifest.version + 1
            manifest = self.manifest()
        raise RuntimeError(f"{TRIES} other changes of {self.path} came first")

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Write ``rows`` (missing columns are null, others are left out) and return the version that holds them.

        A ``batch`` number of a ``stream`` that was written before does nothing.
        """
        return self._change(rows, False, stream, batch)

    def delete(self, rows: DataFrame) -> int:
        """Write that the keys of ``rows`` are gone as of their ``order`` columns; later rows bring a key back."""
        return self._change(rows, True, None, None)

    # --- reading ----------------------------------------------------------------------------------------

    def _files(self, manifest: Manifest, folders: list[str]) -> DataFrame:
        """Rows of these folders with the number of the change that wrote them, the bucket's oldest being 0."""
        kinds = f"{manifest.schema}, {GONE} boolean"
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/{f}" for f in folders])

    def _last(self, manifest: Manifest, buckets: list[str]) -> DataFrame:
        """The rows that count in these buckets, deletions among them."""
        depth = max(len(manifest.files[b]) for b in buckets)
        layers = [self._files(manifest, own).withColumn(CHANGE, F.lit(n)) for n in range(depth) if (own := [manifest.files[b][n] for b in buckets if n < len(manifest.files[b])])]
        rows = layers[0]
        for layer in layers[1:]:
            rows = rows.unionByName(layer)
        rest = [c for c in rows.columns if c not in manifest.keys]
        best = rows.groupBy(*manifest.keys).agg(F.max_by(F.struct(*rest), F.struct(*manifest.order, CHANGE)).alias("_r"))
        return best.select(*manifest.keys, "_r.*").drop(CHANGE)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the last one if none is named; it stays that version whatever is written meanwhile."""
        manifest = self.manifest(version)
        columns = [f.name for f in StructType.fromDDL(manifest.schema)]
        plain = [b for b in manifest.merged if len(manifest.files[b]) == 1]
        mixed = [b for b in manifest.files if b not in plain]
        parts = [self._files(manifest, [manifest.files[b][0] for b in plain])] if plain else []
        parts += [self._last(manifest, mixed).where(~F.col(GONE))] if mixed else []
        if not parts:
            return self.spark.createDataFrame([], manifest.schema)
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).select(*columns)

    # --- upkeep -----------------------------------------------------------------------------------------

    def compact(self, most: int = 4) -> int:
        """Merge the files of buckets that have more than ``most``; the version afterwards.

        Rows written meanwhile stay.  A deletion goes with the rows that it removed, so a row older than it counts if it comes
        after the merge.
        """
        manifest = self.manifest()
        buckets = [b for b, files in manifest.files.items() if len(files) > most]
        if not buckets:
            return manifest.version
        new = self._write(self._last(manifest, buckets).where(~F.col(GONE)), manifest, uuid.uuid4().hex)
        for _ in range(TRIES):
            now = self.manifest()
            files, merged = dict(now.files), set(now.merged)
            for b in buckets:
                held = manifest.files[b]
                if now.files.get(b, [])[: len(held)] != held:  # another one merged it
                    continue
                files[b] = ([new[b]] if b in new else []) + now.files[b][len(held) :]
                merged |= {b}
                if not files[b] or b not in new:
                    merged -= {b}
                if not files[b]:
                    del files[b]
            if self._commit(Manifest(**now.__dict__ | {"version": now.version + 1, "files": files, "merged": sorted(merged)})):
                return now.version + 1
        raise RuntimeError(f"{TRIES} other changes of {self.path} came first")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests of all but the last ``keep`` versions and the folders that no kept one lists; how many folders.

        For when nobody reads older versions and nobody is writing: files of a change that does not yet count go too.
        """
        versions = self.versions()
        listed = {f for v in versions[-keep:] for files in self.manifest(v).files.values() for f in files}
        for version in versions[:-keep]:
            remove(self.spark, f"{self.path}/manifests/{version:012}.json")
        where, gone = self._at("files"), 0
        disk = where.getFileSystem(self._conf)
        for change in disk.listStatus(where) if disk.exists(where) else []:
            name = f"files/{change.getPath().getName()}"
            for bucket in disk.listStatus(change.getPath()):
                folder = f"{name}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and folder not in listed:
                    remove(self.spark, f"{self.path}/{folder}")
                    gone += 1
        return gone
