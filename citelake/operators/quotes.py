"""Where pages hold quotes: all quotes searched at once in one walk over each page.

Quotes are folded as pages are (Unicode forms, typography, Markdown and case do not count), each different one is a pattern, and
patterns are cut into blocks of bounded size.  A block goes out as one broadcast, each worker builds its Aho-Corasick
automaton once, and every page is walked once a block, in time linear in its length and its hits.  Only hits are returned:
pairs without one never exist as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import fold
from citelake.operators.shared import Pieces, written

#: Characters of the patterns of one automaton; one takes about a hundred bytes a character in each worker.
BLOCK_CHARS = 1 << 20
_AUTOMATON: dict[str, object] = {}


def folded(column: str) -> Column:
    """The text as it is compared; null is empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fold(t or ""))

    return run(column)


def automaton(name: str, patterns: list[str]):
    """The automaton of a block; a worker holds the one of the block at hand."""
    if name not in _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        for pattern in patterns:
            made.add_word(pattern, pattern)
        made.make_automaton()
        _AUTOMATON.clear()
        _AUTOMATON[name] = made
    return _AUTOMATON[name]


def _walk(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(*block.value)
        for batch in batches:
            rows, patterns, places = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for end, pattern in found.iter(text or ""):
                    rows.append(row)
                    patterns.append(pattern)
                    places.append(end - len(pattern) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(patterns, pa.string()), pa.array(places, pa.int32())], names=["page", "pattern", "at"])

    return run


def quote_hits(quotes: DataFrame, pages: DataFrame, quote_id: str, page_id: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``quote_id, page_id, at`` for every occurrence of a quote (``quote_id, quote``) in a page (``page_id, text``).

    ``at`` counts characters of the folded page from 0; occurrences may overlap.  A quote that is null or folds to nothing
    is on no page, a null page holds none; rows that repeat an id are told each.  Empty tables give an empty result.
    """
    spark = pages.sparkSession
    told = written(quotes.select(quote_id, folded("quote").alias("pattern")).where("pattern <> ''"), "quotes")
    patterns = told.select("pattern").distinct()
    size = patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = -(-size // block_chars)
    patterns = written(patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(max(1, blocks)))), "patterns")
    plain = pages.select(F.col(page_id).alias("page"), folded("text").alias("text"))
    if blocks > 1:
        plain = written(plain, "folded")
    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page {kind}, pattern string, at int"
    pieces = Pieces(spark, "hits", schema)
    for block in range(blocks):
        own = [r["pattern"] for r in patterns.where(F.col("block") == block).select("pattern").collect()]
        if own:  # patterns of about ``block_chars`` characters
            pieces.add(plain.mapInArrow(_walk(spark.sparkContext.broadcast((f"{pieces.path}/{block}", own))), schema))
    hits = pieces.table()
    return hits.join(told, "pattern").select(quote_id, F.col("page").alias(page_id), "at")


def quotes_on_page(quotes: DataFrame, pages: DataFrame, on: str) -> DataFrame:
    """Quotes (``on, quote``) with ``found``: whether the page with the same key holds them, ignoring form and markup."""
    plain = pages.select(on, folded("text").alias("_page"))
    return quotes.join(plain, on, "left").withColumn("found", F.coalesce(F.contains("_page", folded("quote")), F.lit(False))).drop("_page")
