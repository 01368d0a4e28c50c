"""The corpus pipeline: raw documents to encoded training documents in curriculum order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelake.llm import lang_id, sp_encode
from citelake.llm.exact_dedup import drop_exact_copies
from citelake.llm.mixing import curriculum
from citelake.llm.near_dedup import drop_near_copies
from citelake.llm.queries import SENTENCEPIECE_MODEL
from citelake.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter (null and empty ones too) go.

    Repeated rows are judged alike.  Where no language can be learned (an empty table, no ``lang``) all texts with a letter stay.
    """
    return lang_id.drop_undetermined(docs, lang_id.fit(docs))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; null counts as the empty text, and one row of equal rows stays."""
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their five-word shingles, the row with the smallest id.

    Texts without words and rows without an id stay.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents as often as their source's target takes them, in order of position (ties by id).

    Texts without words are left out; a null source is a source.
    """
    return curriculum(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the sequence; a document that stands in it twice is encoded twice."""
    return sp_encode.encode(docs, sp_encode.load(SENTENCEPIECE_MODEL))


STAGES = [
    ("language identification", identify_language),
    ("exact deduplication", remove_exact_copies),
    ("near deduplication", remove_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: SQL can express neither the parse against automata nor banded sketches; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written below the shared folder and read by the next.

    A stage's table is deleted once the next one is written; the last stage's input goes when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(n))
        if n:
            scratch.drop(str(n - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
