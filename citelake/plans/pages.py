"""The page pipeline: stored pages to distinct Markdown, chunks, terms, links and knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import chunks
from citelake.operators.chunking import top_terms
from citelake.operators.dedup import exact_keep, greedy_keep
from citelake.operators.frontier import allowed, expand, link_table, within_cap
from citelake.operators.markdown import page_markdown
from citelake.operators.shared import written


def distinct_pages(pages: DataFrame, near: bool = True, loose: bool = True, repeats: bool = False) -> DataFrame:
    """Pages (``page_id, url, html``) as Markdown, without empty ones and without (near) copies of earlier ones."""
    rendered = written(page_markdown(pages, loose=loose, repeats=repeats).where(F.length("markdown") > 0), "markdown")
    if not near:
        return exact_keep(rendered, "markdown", "page_id")
    verdict = greedy_keep(rendered, "page_id", "markdown").where("kept").select("page_id")
    return rendered.join(verdict, "page_id", "left_semi")


def page_terms(pages: DataFrame, k: int = 10, loose: bool = True, repeats: bool = False) -> DataFrame:
    """The flagship query: what the chunks of the distinct pages are about, with their source.

    ``page_id, url, chunks, rank, term, n, tf``: the ``k`` most frequent terms of each distinct page.
    """
    kept = written(distinct_pages(pages, loose=loose, repeats=repeats), "distinct")
    pages = kept.select("page_id", "url", F.size(chunks(F.col("markdown"))).cast("long").alias("chunks"))
    return pages.join(top_terms(kept, k, "page_id", "markdown"), "page_id").select("page_id", "url", "chunks", "rank", "term", "n", "tf")


def crawl(pages: DataFrame, seed: str, max_depth: int = 1, max_pages: int = 50, robots: DataFrame | None = None) -> DataFrame:
    """``url, depth`` of the stored pages that a crawl from ``seed`` visits, in order, at most ``max_pages``.

    With ``robots`` (``host, text``), links that their host disallows are not followed, and a disallowed seed gives nothing.  The
    pages' links are read and judged once, whatever the depth.
    """
    links = link_table(pages)
    seeds = pages.sparkSession.createDataFrame([(seed,)], "node string")
    if robots is not None:
        links, seeds = allowed(links, robots), allowed(seeds, robots, link_col="node")
    edges = written(links.select(F.col("url").alias("src"), F.col("link").alias("dst")), "edges")
    reached = expand(edges, seeds, max_depth)
    return within_cap(reached.join(pages.select(F.col("url").alias("node")).distinct(), "node"), max_pages, "node").select(F.col("node").alias("url"), "depth")
