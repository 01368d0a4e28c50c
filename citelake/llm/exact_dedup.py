"""Exact deduplication by progressive refinement, in DataFrame operations only.

Pass 1 reads lengths and keeps the lengths that occur more than once; pass 2 hashes a prefix of the rows
whose length survived; pass 3 hashes the full text of the rows whose (length, prefix hash) survived.  What
survived a pass is told to the next one by a bitmap of a fixed number of bits (1 MB by default, whatever the
corpus holds).  A bit that two keys share only lets a row into the next pass,
where it is told apart, so results are exact; texts never leave the task that scanned them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.bitmap import BITS, bitmap_of, flag, possible

PREFIX_CHARS = 64
FILTER_BITS = BITS


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per text that occurs more than once: ``n_bytes, text_sha256, keep_id, group_size``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("n_bytes"))
    lengths = base.groupBy("n_bytes").count().where("count > 1")
    second = possible(base, F.col("n_bytes"), bitmap_of(lengths, F.col("n_bytes"), filter_bits), filter_bits)
    second = second.withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix_chars)))
    pair = F.struct("n_bytes", "_prefix")
    prefixes = second.groupBy("n_bytes", "_prefix").count().where("count > 1")
    third = possible(second, pair, bitmap_of(prefixes, pair, filter_bits), filter_bits)
    return (
        third.select("_id", "n_bytes", F.sha2("_text", 256).alias("text_sha256"))
        .groupBy("n_bytes", "text_sha256")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **refinement) -> DataFrame:
    """Decision for every row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text counts as empty.  The row with the largest id of a group
    stays (a null id loses to any other).  Rows that repeat both id and text are one record told several
    times: each is reported with the same decision.  An empty table gives an empty result.  Other columns
    of ``docs`` are not read, so their names cannot clash.
    """
    groups = duplicate_groups(docs, id_col, text_col, **refinement).withColumnRenamed("text_sha256", "__cl_g_sha")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("text_sha256"))
    # a key of its own makes Spark deal both sides for this join, so that it can split the rows of a hot text
    groups = groups.withColumn("_g_key", F.unhex("__cl_g_sha"))
    joined = rows.join(groups, F.unhex("text_sha256") == F.col("_g_key"), "left")
    in_group = F.col("group_size").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(in_group, F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.when(in_group, F.col("_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **refinement) -> DataFrame:
    """``docs`` with one row per text, all columns kept.

    Only rows that may have a copy (their bit of the last bitmap is set) are shuffled; all others pass
    straight from the scan.  Rows that repeat both id and text collapse into one.
    """
    bits = refinement.get("filter_bits", FILTER_BITS)
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = duplicate_groups(docs, id_col, text_col, **refinement)
    groups = groups.select(F.col("text_sha256").alias("__cl_g_sha"), F.col("keep_id").alias("__cl_keep_id"))
    bitmap = bitmap_of(groups, F.col("__cl_g_sha"), bits)
    flagged = flag(docs.withColumn("__cl_sha", F.sha2(text, 256)), F.col("__cl_sha"), bitmap, bits)
    single = flagged.where(~F.col("__cl_maybe")).select(columns)
    maybe = flagged.where("__cl_maybe").join(groups, F.col("__cl_sha") == F.col("__cl_g_sha"), "left")
    stays = F.col("__cl_g_sha").isNull() | F.col(id_col).eqNullSafe(F.col("__cl_keep_id"))
    return single.unionByName(maybe.where(stays).dropDuplicates(["__cl_sha"]).select(columns))
