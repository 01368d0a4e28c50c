"""Rendezvous (highest random weight) sharding of records over weighted shards.

A record's shard depends on its key and the set of shards alone: each shard s scores the key with
``weight / -ln(u(key, s))`` and the largest score takes the record.  Adding a shard moves only the records
that the new shard wins; removing one moves only its own records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.llm.scratch import Scratch, range_buckets


def unit_hash(*cols: Column) -> Column:
    """Uniform in (0, 1), from the upper 53 bits of a 64-bit hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number (from 0) of the shard that takes ``key``; equal scores go to the lower number."""
    bids = [
        F.struct((F.lit(float(w)) / -F.log(unit_hash(key, F.lit(s)))).alias("bid"), F.lit(-s).alias("rank"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    best = bids[0] if len(bids) == 1 else F.greatest(*bids)
    return (-best["rank"]).cast("int")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Size is the UTF-8 bytes of the text plus 1; a null text has none (size 1, CRC 0).  A null id is a key of
    its own.  ``slot`` numbers a shard's rows from 0 without gaps, in the order of a hash, id, CRC and size;
    rows that agree in all of these are interchangeable and take consecutive slots.  ``grown_shard`` is the
    row's shard after one more shard of ``grown_weight`` joins.  An empty table gives an empty result.

    Slots come from two-level prefix sums: the order's leading hash is uniform, so cutting it into equal
    ranges gives even (shard, range) cells; their counts are summed per shard, and rows are numbered within
    their cell.  Repeated records are counted before the shuffle, so a hot record is one row of it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    records = scratch.keep(read.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")), "records")
    ranges = range_buckets(spark, records.count())
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    placed = (
        records.withColumn("shard", rendezvous_shard(key, weights))
        .withColumn("grown_shard", rendezvous_shard(key, [*weights, grown_weight]))
        .withColumn("_h", unit_hash(key, F.col("text_crc32"), F.lit("slot")))
        .withColumn("_range", F.floor(F.col("_h") * ranges).cast("int"))
    )
    cells = placed.groupBy("shard", "_range").agg(F.sum("_n").alias("_cell"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("shard").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_cell").over(before), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy("shard", "_range")
        .orderBy("_h", "_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = numbered.join(cells, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_offset") + F.col("_before") + F.col("_copy")).alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 16, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet below ``path``, one ``_shard=N`` folder for each shard.

    Each task writes the records of the shards it meets, so no shard is gathered in one task.  A null id is a key like any
    other, repeated ids go to one shard, texts may be null or empty, and an empty table writes no record.  ``_shard`` is the
    operator's own column: a table that has one already raises ``ValueError``.
    """
    if "_shard" in docs.columns:
        raise ValueError("the table has a column _shard, which names the folders")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    docs.withColumn("_shard", rendezvous_shard(key, weights)).write.partitionBy("_shard").mode("overwrite").parquet(path)
