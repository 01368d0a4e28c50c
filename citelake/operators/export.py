"""Results as JSON, JSON lines and CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions.jsonx import escape
from citelake.functions.text import FORMULA_STARTS


def cell(value) -> str:
    """A CSV cell in which a spreadsheet sees no formula."""
    if value is None:
        return ""
    if isinstance(value, str):
        return "'" + value if value.startswith(FORMULA_STARTS) else value
    return json.dumps(value, ensure_ascii=False, default=str)


def structured_table(result: dict, field: str = "") -> tuple[str, list[str], list[list[str]]] | None:
    """(field, columns, rows) of the first list of objects (or the named one), with the URLs that support each row."""
    data = result.get("data")
    lists = data.items() if isinstance(data, dict) else ()
    name = next((k for k, v in lists if isinstance(v, list) and v and all(isinstance(i, dict) for i in v) and field in ("", k)), None)
    if name is None:
        return None
    items = data[name]
    columns = list(dict.fromkeys(c for item in items for c in item))
    urls: dict[str, set[str]] = {}
    stem = f"/{escape(name)}/"
    for where, quotes in (result.get("citations") or {}).items():
        if where.startswith(stem) and "/" in where[len(stem) :]:
            index = where[len(stem) :].split("/", 1)[0]
            urls.setdefault(index, set()).update(q["url"] for q in quotes if q.get("url"))
    rows = [[cell(item.get(c)) for c in columns] + [" ".join(sorted(urls.get(str(n), ())))] for n, item in enumerate(items)]
    return name, [*columns, "sources"], rows


def to_csv(columns: list[str], rows: Iterable[list[str]]) -> str:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue()


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text for each row, in a column ``value`` (write it with ``.write.text``)."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def page_summary(pages: DataFrame) -> DataFrame:
    """Counts of what each page gave."""
    def size(column):
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))

    return pages.select(
        "url", size("entities").alias("entities"), size("triples").alias("triples"),
        size(F.map_keys("citations")).alias("verified"), size("unverified").alias("unverified"),
    )


def job_view(jobs: DataFrame, most_errors: int = 20) -> DataFrame:
    """Jobs newest first, with at most ``most_errors`` errors and their duration in seconds."""
    took = F.round(F.coalesce(F.col("finished_at"), F.col("created_at")) - F.coalesce(F.col("started_at"), F.col("created_at")), 2)
    return jobs.withColumns({"errors": F.slice("errors", 1, most_errors), "duration_s": took}).orderBy(F.desc("created_at"), "job_id")


def command_line_report(pages: DataFrame, seed: str, max_depth: int, skipped: int) -> DataFrame:
    """The crawl as one JSON document for each run; its pages are those of one crawl."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "url", "markdown")))
    return pages.agg(listed.alias("results")).select(
        F.to_json(
            F.struct(
                F.lit(seed).alias("seed"), F.lit(max_depth).alias("max_depth"), F.size("results").alias("pages_crawled"),
                F.lit(skipped).alias("duplicates_skipped"), "results",
            )
        ).alias("value")
    )
