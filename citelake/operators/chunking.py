"""Chunks of texts and their sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import CHUNK_OVERLAP, CHUNK_WORDS, bound, chunks, words


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``id, chunk_index, chunk``; a text without a word has no chunk."""
    return docs.select(F.col(id_col), F.posexplode(chunks(F.col(text_col), size, overlap)).alias("chunk_index", "chunk"))


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, term, n, tf``: lower-cased words with their count and share of the text.

    The text's word count travels with its words, so one shuffle does for both.
    """
    each = bound(words(F.lower(text_col)), lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("total"), x.alias("term"))))
    flat = docs.select(F.col(id_col), F.inline(each))
    counted = flat.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    return counted.select(id_col, "term", "n", (F.col("n") / F.col("total")).alias("tf"))


def top_terms(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` most frequent terms of each text (ties by term), ranked from 1."""
    rows = term_frequencies(docs, id_col, text_col)
    best = rows.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "term", "n", "tf"))), 1, k).alias("best"))
    return best.select(id_col, F.posexplode("best").alias("rank", "b")).select(id_col, (F.col("rank") + 1).alias("rank"), "b.term", "b.n", "b.tf")
