"""Fixed-size bitmaps of hashed keys: a broadcast whose size does not depend on the data.

A bitmap tells which rows cannot have a key of a set, so that only the others need an exact join.  Keys that
share a bit make the exact step read more rows, never give other results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 131,072 rows of two longs at most.
BITS = 1 << 23


def bitmap_of(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """The bitmap as words of 64 bits: at most ``bits`` / 64 rows."""
    slots = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    return slots.groupBy(F.shiftright("slot", 6).alias("__cl_bm_word")).agg(F.bit_or(bit).alias("__cl_bm_bits"))


def flag(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with ``__cl_maybe``: whether the hashed key has its bit set."""
    at = F.col("__cl_bm_slot").bitwiseAND(F.lit(63)).cast("int")
    is_set = F.call_function("shiftrightunsigned", F.col("__cl_bm_bits"), at).bitwiseAND(F.lit(1)) == 1
    return (
        rows.withColumn("__cl_bm_slot", F.pmod(F.xxhash64(key), F.lit(bits)))
        .withColumn("__cl_bm_at", F.shiftright("__cl_bm_slot", 6))
        .join(F.broadcast(bitmap), F.col("__cl_bm_at") == F.col("__cl_bm_word"), "left")
        .withColumn("__cl_maybe", F.coalesce(is_set, F.lit(False)))
        .drop("__cl_bm_slot", "__cl_bm_at", "__cl_bm_word", "__cl_bm_bits")
    )


def possible(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose key may be in the set."""
    return flag(rows, key, bitmap, bits).where("__cl_maybe").drop("__cl_maybe")


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str, bits: int = BITS) -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped`` (one column); only rows that may be dropped are shuffled."""
    key = F.col(id_col)
    dropped = dropped.toDF("__cl_drop_id")
    flagged = flag(docs, key, bitmap_of(dropped, F.col("__cl_drop_id"), bits), bits)
    sure = flagged.where(~F.col("__cl_maybe")).drop("__cl_maybe")
    rest = flagged.where("__cl_maybe").drop("__cl_maybe")
    return sure.unionByName(rest.join(dropped, F.col(id_col) == F.col("__cl_drop_id"), "left_anti"))
