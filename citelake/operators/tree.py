"""Pages as rows of their element tree, and rules about pages as joins of these rows.

A page is parsed once.  Each node is a row with its number in document order (``pre``), the number of its last descendant (``last``),
its depth and the numbers of the elements that hold it (``above``, outermost first); a node is inside an element iff its number
lies in ``(pre, last]``, iff the element's number is in its ``above``.  So "inside" is an equality join on page and number over the
few elements above a node, never a comparison of all nodes of a page with each other.

Rules that need one page at a time can also read it as one row (:func:`page_trees`), whose nodes are an array in document order: what
is inside an element is a slice of it, so nothing is dealt out or written but the rows that the rules give.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import html

NODE = "pre int, last int, depth int, tag string, text string, href string, above array<int>"
_KINDS = {"pre": pa.int32(), "last": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "text": pa.string(), "href": pa.string(), "above": pa.list_(pa.int32())}
#: Nodes that a worker holds before it gives them on (those of one page more at most).
HELD = 8192
#: Names of nodes that are no elements.
TEXT, NOTE = "#text", "#note"
CELLS = ("td", "th")


def node_rows(pages: DataFrame, page: str, source: str = "html", loose: bool = True) -> DataFrame:
    """``page, pre, last, depth, tag, text, href, above`` for every node of every page; an empty or null page has none.

    Write it once for several rules.  ``loose`` as in :mod:`citelake.functions.html`.
    """

    def told(ids: pa.Array, places: list[int], nodes: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([n[c] for n in nodes], kind) for c, kind in _KINDS.items()]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(places)), *columns], names=[page, *_KINDS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            nodes: list[dict] = []
            for k in range(batch.num_rows):
                found = html.numbered(batch.column(1)[k].as_py(), loose)
                places += [k] * len(found)
                nodes += found
                if len(nodes) >= HELD:
                    yield told(batch.column(0), places, nodes)
                    places, nodes = [], []
            if nodes:
                yield told(batch.column(0), places, nodes)

    kind = pages.schema[page].dataType.simpleString()
    return pages.select(page, source).mapInArrow(cut, f"`{page}` {kind}, {NODE}")


def inside(nodes: DataFrame, page: str, elements: DataFrame, nearest: bool = False) -> DataFrame:
    """``nodes`` paired with the ``elements`` (``page, pre, tag``) that hold them, as ``holder`` and ``holder_tag``; only the innermost if ``nearest``."""
    held = elements.select(F.col(page).alias("_page"), F.col("pre").alias("holder"), F.col("tag").alias("holder_tag"))
    pairs = nodes.withColumn("_up", F.explode("above")).join(held, (F.col(page) == F.col("_page")) & (F.col("_up") == F.col("holder"))).drop("_page", "_up")
    if nearest:
        inner = pairs.groupBy(page, "pre").agg(F.max(F.struct("holder", "holder_tag")).alias("_h"))
        inner = inner.select(F.col(page).alias("_page"), F.col("pre").alias("_pre"), "_h.*")
        pairs = nodes.join(inner, (F.col(page) == F.col("_page")) & (F.col("pre") == F.col("_pre"))).drop("_page", "_pre")
    return pairs


def shown(nodes: DataFrame, page: str) -> DataFrame:
    """The nodes that are neither stripped nor inside a stripped element."""
    gone = nodes.where(F.col("tag").isin(*html.STRIPPED, *html.SKIPPED))
    below = inside(nodes.select(page, "pre", "above"), page, gone).select(F.col(page).alias("_page"), F.col("pre").alias("_pre"))
    rest = nodes.where(~F.col("tag").isin(*html.STRIPPED, *html.SKIPPED))
    return rest.join(below, (F.col(page) == F.col("_page")) & (F.col("pre") == F.col("_pre")), "left_anti")


def _joined(pre: str = "pre", text: str = "text") -> Column:
    """The texts of a group in document order, with single spaces."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pre).alias("pre"), F.col(text).alias("text")))), lambda x: x["text"])
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " "))


def texts_of(nodes: DataFrame, page: str, *tags: str) -> DataFrame:
    """``page, pre, tag, text`` of the elements of these names: all text inside, with single spaces (empty where there is none)."""
    elements = nodes.where(F.col("tag").isin(*tags)).select(page, "pre", "tag")
    found = inside(nodes.where(F.col("tag") == TEXT).select(page, "pre", "text", "above"), page, elements)
    found = found.groupBy(F.col(page).alias("_page"), "holder").agg(_joined().alias("text"))
    return elements.join(found, (F.col(page) == F.col("_page")) & (F.col("pre") == F.col("holder")), "left").select(page, "pre", "tag", F.coalesce("text", F.lit("")).alias("text"))


def headings(nodes: DataFrame, page: str) -> DataFrame:
    """``page, pre, level, text`` of the headings that have text."""
    found = texts_of(nodes, page, *html.HEADINGS).where("text <> ''")
    return found.select(page, "pre", F.substring("tag", 2, 1).cast("int").alias("level"), "text")


def list_items(nodes: DataFrame, page: str) -> DataFrame:
    """``page, pre, level, ordered, number, text`` of list items that have text of their own, which leaves out lists inside them.

    ``level`` counts the lists around the item's list, ``number`` the items of its list up to it.
    """
    lists = nodes.where(F.col("tag").isin(*html.LISTS)).select(page, "pre", "tag")
    items = nodes.where("tag = 'li'").select(page, "pre", "tag", "above")
    around = inside(items, page, lists).groupBy(page, "pre").agg((F.count(F.lit(1)) - 1).cast("int").alias("level"), F.max(F.struct("holder", "holder_tag")).alias("list"))
    texts = inside(nodes.where(F.col("tag") == TEXT).select(page, "pre", "text", "above"), page, lists.unionByName(items.select(page, "pre", "tag")), nearest=True)
    texts = texts.where("holder_tag = 'li'").groupBy(F.col(page).alias("_page"), "holder").agg(_joined().alias("text")).where("text <> ''")
    found = around.join(texts, (F.col(page) == F.col("_page")) & (F.col("pre") == F.col("holder")))
    number = F.row_number().over(Window.partitionBy(page, "list.holder").orderBy("pre"))
    return found.select(page, "pre", "level", (F.col("list.holder_tag") == "ol").alias("ordered"), number.alias("number"), "text")


def table_cells(nodes: DataFrame, page: str) -> DataFrame:
    """``page, table, row, column, text`` of the cells of tables (``table`` is its number among the page's tables, ``row`` and ``column`` count from 1)."""
    rows = nodes.where("tag = 'tr'").select(page, "pre", "tag", "above")
    tables = nodes.where("tag = 'table'").select(page, "pre", "tag")
    placed = inside(rows, page, tables, nearest=True)
    numbers = tables.select(F.col(page).alias("_of"), F.col("pre").alias("_table"), F.row_number().over(Window.partitionBy(page).orderBy("pre")).alias("table"))
    placed = placed.join(numbers, (F.col(page) == F.col("_of")) & (F.col("holder") == F.col("_table"))).select(F.col(page).alias("_page"), F.col("pre").alias("_row"), "table")
    cells = nodes.where(F.col("tag").isin(*CELLS)).select(page, "pre", "above")
    cells = inside(cells, page, rows, nearest=True).select(page, F.col("pre").alias("_cell"), F.col("holder").alias("_in"))
    joined = cells.join(placed, (F.col(page) == F.col("_page")) & (F.col("_in") == F.col("_row"))).drop("_page")
    joined = joined.join(texts_of(nodes, page, *CELLS).select(F.col(page).alias("_page"), "pre", "text"), (F.col(page) == F.col("_page")) & (F.col("_cell") == F.col("pre")))
    row = F.dense_rank().over(Window.partitionBy(page, "table").orderBy("_in"))
    column = F.row_number().over(Window.partitionBy(page, "_in").orderBy("_cell"))
    return joined.select(page, "table", row.alias("row"), column.alias("column"), "text")


TREE = "array<struct<pre: int, last: int, tag: string, text: string, above: array<int>>>"
#: The tag of nodes that do not show.
GONE = "#gone"


def page_trees(pages: DataFrame, page: str, source: str = "html", loose: bool = True) -> DataFrame:
    """``page, nodes`` for every page: its nodes in document order, so that a node's number is its place.  ``loose`` as in :mod:`citelake.functions.html`."""
    names = ("pre", "last", "tag", "text", "above")

    def told(ids: pa.Array, sizes: list[int], nodes: list[dict]) -> pa.RecordBatch:
        flat = pa.StructArray.from_arrays([pa.array([n[c] for n in nodes], _KINDS[c]) for c in names], names=list(names))
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), flat)], names=[page, "nodes"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes, nodes = 0, [], []
            for k in range(batch.num_rows):
                found = html.numbered(batch.column(1)[k].as_py(), loose)
                sizes.append(len(found))
                nodes += found
                if len(nodes) >= HELD:
                    yield told(batch.column(0).slice(first, len(sizes)), sizes, nodes)
                    first, sizes, nodes = k + 1, [], []
            if sizes:
                yield told(batch.column(0).slice(first, len(sizes)), sizes, nodes)

    kind = pages.schema[page].dataType.simpleString()
    return pages.select(page, source).mapInArrow(cut, f"`{page}` {kind}, nodes {TREE}")


def shown_nodes(nodes: Column) -> Column:
    """``nodes`` in their places, those that are stripped or inside a stripped element without text and by the name ``GONE``."""
    closed = lambda tag: tag.isin(*html.STRIPPED, *html.SKIPPED)
    hidden = lambda n: closed(n["tag"]) | F.exists(n["above"], lambda p: closed(nodes[p]["tag"]))
    return F.transform(nodes, lambda n: F.when(hidden(n), n.withField("tag", F.lit(GONE)).withField("text", F.lit(None).cast("string"))).otherwise(n))


def _below(nodes: Column, element: Column) -> Column:
    return F.slice(nodes, element["pre"] + 2, element["last"] - element["pre"])


def _nearest(nodes: Column, node: Column, *tags: str) -> Column:
    """The number of the innermost element of these names that holds ``node``; null without one."""
    return F.array_max(F.filter(node["above"], lambda p: nodes[p]["tag"].isin(*tags)))


def _text_of(nodes: Column, element: Column, own=lambda n: F.lit(True)) -> Column:
    """The texts inside ``element`` (those that ``own`` takes) with single spaces."""
    texts = F.filter(_below(nodes, element), lambda n: (n["tag"] == TEXT) & own(n))
    return F.trim(F.regexp_replace(F.array_join(F.transform(texts, lambda n: n["text"]), ""), r"\s+", " "))


def tree_headings(nodes: Column) -> Column:
    """An array of ``level, text``: as :func:`headings`, in document order."""
    found = F.transform(
        F.filter(nodes, lambda n: n["tag"].isin(*html.HEADINGS)), lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), _text_of(nodes, n).alias("text"))
    )
    return F.filter(found, lambda h: h["text"] != "")


def tree_list_items(nodes: Column) -> Column:
    """An array of ``level, ordered, number, text``: as :func:`list_items`, list by list."""
    kinds = sorted(html.LISTS)

    def of(held: Column) -> Column:
        own = F.filter(_below(nodes, held), lambda n: (n["tag"] == "li") & (_nearest(nodes, n, *kinds) == held["pre"]))
        texts = F.transform(own, lambda item: _text_of(nodes, item, lambda n: _nearest(nodes, n, "li", *kinds) == item["pre"]))
        level = F.size(F.filter(held["above"], lambda p: nodes[p]["tag"].isin(*kinds)))
        return F.transform(F.filter(texts, lambda t: t != ""), lambda t, i: F.struct(level.alias("level"), (held["tag"] == "ol").alias("ordered"), (i + 1).alias("number"), t.alias("text")))

    return F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"].isin(*kinds)), of))


def tree_table_cells(nodes: Column) -> Column:
    """An array of ``table, row, column, text``: as :func:`table_cells`, in the order of tables, rows and columns."""

    def of(held: Column, table: Column) -> Column:
        rows = F.filter(_below(nodes, held), lambda n: (n["tag"] == "tr") & (_nearest(nodes, n, "table") == held["pre"]))
        cells = F.transform(rows, lambda r: F.filter(_below(nodes, r), lambda n: n["tag"].isin(*CELLS) & (_nearest(nodes, n, "tr") == r["pre"])))
        placed = lambda c, row, column: F.struct((table + 1).alias("table"), (row + 1).alias("row"), (column + 1).alias("column"), _text_of(nodes, c).alias("text"))
        return F.flatten(F.transform(F.filter(cells, lambda x: F.size(x) > 0), lambda x, row: F.transform(x, lambda c, column: placed(c, row, column))))

    return F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "table"), of))
