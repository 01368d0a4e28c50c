"""Which document filter removes what, in every order in which the filters can be applied.

Each document's outcome under the filters is a mask of failed conditions.  The masks are replayed against every
order: crossed with the broadcast orders (n! rows for n filters, a number that no data changes), one row a step,
the first failing step of each document and order, and conditional sums that combine within a task before a
shuffle.  What is shuffled is parts x orders x steps rows a task, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.scratch import Scratch

SPACES = " \t\n\x0b\f\r"
#: 720 orders of 4,320 steps; more filters are an error.
MOST_FILTERS = 6


def word_counts(text: Column) -> tuple[Column, Column]:
    """The words of a text as an array (one empty word where there is none), and whether there are any."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.split(bare, r"[\x20\x09-\x0D]+"), bare != ""


def failures(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, A, B, C, D, E`` for every row: the part (null: empty string) and which conditions it fails.

    A: under 200 words.  B: 100 * distinct words < 50 * words.  C: 100 * capitals A-Z > 3 * code points.  D: holds one of
    ``#$%&*|``.  E: a smaller id has the same text.  Null text is empty; a row without an id has no smaller one.
    The text is read once; what is grouped and joined for E is a digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, some = word_counts(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", words.alias("words"), some.alias("some"))
    rows = rows.select("*", F.when(F.col("some"), F.size("words")).otherwise(0).alias("n"), F.when(F.col("some"), F.size(F.array_distinct("words"))).otherwise(0).alias("kinds"))
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    told = rows.select(
        "id", "part", (F.col("n") < 200).alias("A"), (100 * F.col("kinds") < 50 * F.col("n")).alias("B"),
        (100 * capitals.cast("long") > 3 * F.length("text").cast("long")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    told = scratch.keep(told, "told")
    copied = told.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # a hash in the join key makes Spark deal both sides for the join itself, so that it can split a hot text
    copied = copied.select(F.col("digest").alias("same"), "least", F.xxhash64("digest").alias("key"))
    told = told.join(copied, (F.xxhash64("digest") == F.col("key")) & (F.col("digest") == F.col("same")), "left")
    return told.select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``rows`` with one boolean a mark: whether any label row of the id fulfils it (no label row, no id: false)."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(*[F.coalesce(F.bool_or(on), F.lit(False)).alias(f"_{name}") for name, on in marks.items()])
    known = known.withColumn("_key", F.xxhash64("_of"))
    joined = rows.join(known, (F.xxhash64("id") == F.col("_key")) & (F.col("id") == F.col("_of")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_{name}"), F.lit(False)).alias(name) for name in marks])


def replay(flags: DataFrame, filters: list[str], losses: list[str] = ()) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, <loss>_lost.., shapley`` for every part of ``flags``, order and step.

    ``flags`` has a row for each document: ``part``, a boolean for each filter (true: the document fails it) and for each of
    ``losses``.  ``kept`` counts documents left after the step, ``removed`` those that it takes, ``redundant`` those failing its
    filter that an earlier step took, ``unique_fails`` those failing only this filter, ``<loss>_lost`` removed ones with that
    mark, and ``shapley`` what the filter removes at any step, summed over all orders.  Filter names are one character
    each.  A null flag is false, repeated rows count each, an empty table gives an empty result.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len(set(filters)) < n or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters, named by one character each")
    bit = {name: 1 << k for k, name in enumerate(filters)}
    steps = [f"s{k}" for k in range(1, n + 1)]
    orders = flags.sparkSession.createDataFrame(
        [("".join(order), *[bit[name] for name in order]) for order in permutations(filters)], "filter_order string, " + ", ".join(f"{s} int" for s in steps)
    )
    fails = sum((F.when(F.col(name), F.lit(bit[name])).otherwise(0) for name in filters[1:]), F.when(F.col(filters[0]), F.lit(1)).otherwise(0))
    masks = flags.select("part", fails.alias("fails"), *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in losses])
    crossed = masks.crossJoin(F.broadcast(orders))
    first = F.lit(n)
    for k in range(n - 1, -1, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col(steps[k])) != 0, k).otherwise(first)
    each = crossed.select("part", "filter_order", "fails", first.alias("first"), *losses, F.posexplode(F.array(*steps)).alias("at", "mask"))
    here = F.col("first") == F.col("at")
    count = lambda on: F.sum(F.when(on, 1).otherwise(0).cast("long"))
    summed = each.groupBy("part", "filter_order", "at").agg(
        count(F.col("first") > F.col("at")).alias("kept"), count(here).alias("removed"),
        count((F.col("first") < F.col("at")) & (F.col("fails").bitwiseAND(F.col("mask")) != 0)).alias("redundant"),
        count(F.col("fails") == F.col("mask")).alias("unique_fails"), *[count(here & F.col(x)).alias(f"{x}_lost") for x in losses],
    )
    summed = summed.withColumn("step", (F.col("at") + 1).cast("int")).withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    over = Window.partitionBy("part", "filter")
    return summed.select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in losses],
        F.sum("removed").over(over).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The replay of the five conditions of :func:`failures`, with losses of good (``quality`` 1) and ``toxic`` (1) documents.

    Labels are looked up by id, any of several rows of one id counts; other columns are not read.  No documents, no rows;
    no labels, no losses.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    flags = failures(docs, scratch, id_col, text_col, part_col)
    flags = with_labels(flags, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, id_col)
    return replay(flags, list("ABCDE"), ["good", "toxic"])
