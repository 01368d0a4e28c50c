"""Reading stored tables: the lists that the service offers, and evaluation fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.functions.text import optional_filter, url_fingerprint


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; timestamps without a zone are read as UTC."""
    read = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [f.name for f in read.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return read.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else read


def recent(rows: DataFrame, by: str, tie: str, limit: int, offset: int = 0, **equal: str | None) -> DataFrame:
    """The newest rows first (ties by the larger ``tie``), filtered by the columns whose value is given and not blank."""
    for column, value in equal.items():
        rows = rows.where(optional_filter(F.col(column), value))
    return rows.orderBy(F.desc(by), F.desc(tie)).offset(offset).limit(limit)


def page_by_url(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url_hash") == F.sha2(F.trim(F.lit(url)), 256)) if "url_hash" in pages.columns else pages.where(
        url_fingerprint(F.col("url")) == F.sha2(F.trim(F.lit(url)), 256)
    )


def counts(tables: dict[str, DataFrame], allowed: tuple[str, ...]) -> DataFrame:
    """``table_name, n`` for each table; ``ValueError`` for a name that is not allowed."""
    unknown = sorted(set(tables) - set(allowed))
    if unknown:
        raise ValueError(f"unknown table: {unknown[0]}")
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table")
    return out


def extraction_results(rows: DataFrame, job_id: str, limit: int = 500) -> DataFrame:
    """A job's results in order, the structured part in one column."""
    structured = F.struct("data", "citations", "unverified").alias("structured")
    kept = [c for c in rows.columns if c not in ("data", "citations", "unverified")]
    return rows.where(F.col("job_id") == job_id).orderBy("id").limit(limit).select(*kept, structured)


def fixtures(spark: SparkSession, folder: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Folders of ``task.json``, ``gold.json`` and (if there) ``page.html``: ``fixture, task, gold, html`` by name."""

    def files(name: str, column: str) -> DataFrame:
        read = spark.read.text(f"{folder}/*/{name}", wholetext=True)
        return read.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("fixture"), F.col("value").alias(column))

    out = files("task.json", "task").join(files("gold.json", "gold"), "fixture").join(files("page.html", "html"), "fixture", "left")
    return (out.where(F.col("fixture").isin(*only)) if only else out).orderBy("fixture")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """HTML files below ``folder`` as ``url, html``: the connector for pages that a browser stored."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
