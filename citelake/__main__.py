"""``python -m citelake crawl --pages FOLDER --url SEED``: a crawl over stored pages, told as one JSON document."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from citelake.operators.dedup import greedy_keep
from citelake.operators.export import command_line_report
from citelake.operators.files import write_text
from citelake.operators.markdown import page_markdown
from citelake.plans.pages import crawl
from citelake.session import session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="citelake")
    command = out.add_subparsers(dest="command", required=True).add_parser("crawl", help="visit stored pages from a seed")
    command.add_argument("--pages", required=True, help="Parquet table of pages: page_id, url, html")
    command.add_argument("--url", required=True, help="where the crawl begins")
    command.add_argument("--depth", type=int, default=1, help="links followed from the seed")
    command.add_argument("--most", type=int, default=50, help="pages visited at most")
    command.add_argument("--output", help="file for the report, in any file system that Spark reaches; standard output if not given")
    return out


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = session()
    pages = spark.read.parquet(given.pages)
    visited = crawl(pages, given.url, given.depth, given.most).select("url")
    rendered = page_markdown(pages.join(visited, "url", "left_semi"))
    kept = greedy_keep(rendered, "page_id", "markdown").where("kept").select("page_id")
    told = rendered.join(kept, "page_id", "left_semi").select(F.col("page_id").alias("seq"), "url", "markdown")
    skipped = rendered.count() - told.count()
    report = command_line_report(told, given.url, given.depth, skipped)
    if given.output:
        write_text(report, given.output)
    else:
        print(report.first()["value"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
