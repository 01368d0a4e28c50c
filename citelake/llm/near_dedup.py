"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: ``bins`` coordinates are filled in rounds.  In round i < bins every element of a document's shingle set
goes to one hashed bin with the value (i, hash); a bin keeps its least value, so a bin filled in an earlier
round never changes.  Rounds end when all bins are full; rounds bins .. 2 * bins - 1 send every element to
bin i - bins, so the last of them leaves none empty.  Two sets agree in a coordinate with probability their
Jaccard similarity, and coordinates are negatively correlated, hence the concentration.

Candidates: documents that agree in all ``rows`` coordinates of one of ``bands`` bands.  At the defaults a pair
of similarity 0.8 shares no band with probability (1 - 0.8^5)^36 < 1e-6.

Links: documents with the same set are one class, told by 128 bits of sums over the set, and only one member
of each class goes on.  Each bucket (band value) has a leader L (from the member whose buckets are largest on to the one
that leads it in several others, and so on up), and each member x is compared with it: ``r`` elements of L are missing in x and ``u`` are new, together its difference D.
Members that link to L are connected through it and need no other pair.  Those of a bucket that do not link to it
elect leaders among themselves, for a few rounds, so that a second or third family is connected at one comparison a
member too.  What is left are pairs of different components with a member that does not link to L, and for two members
under the same leader

    shared(x, y) = |L| - r(x) - r(y) + |D(x) & D(y)|

so linking takes a number of common differences that follows from sizes alone.  Only pairs that can reach it and
have an element in common among the first differences (new ones first, as many as the needed number leaves) are
looked at.  That is exact, and since differences are rare where a group's text is common, a large group of copies
costs a few pairs per member; the members outside the largest component of those with a difference meet all others, so one
that holds nearly all of them is not paired with itself.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.bitmap import bitmap_of, possible, without_ids
from citelake.llm.components import connected_components
from citelake.llm.scratch import Scratch
from citelake.llm.words import WordHasher, mix, row_sums, shingle_hashes, text_chunks
from citelake.llm.worker import tidy

SHINGLE = 5
PERCENT = 80
BANDS = 36
ROWS = 5
#: Buckets that two documents share when one may lead the other's buckets elsewhere.
CLIMB = 4
#: Rounds of leaders among members that do not link to their bucket's first leader.
MORE_LEADERS = 3


def sketch(hashes: np.ndarray, begins: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each row's set of hashes: rows x bins; a row without elements stays at the top value."""
    rows, top = len(begins) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * bins, top, np.uint64)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(begins))
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    for i in range(2 * bins):
        if not len(hashes):
            break
        x = mix(hashes ^ mix(np.array([i + 1], np.uint64))[0])
        at = ((x >> shift) * np.uint64(bins) >> shift).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, row * bins + at, (np.uint64(i) << shift) | (x & low))
        open_rows = (out.reshape(rows, bins) == top).any(axis=1)
        stay = open_rows[row]
        if not stay.all():
            hashes, row = hashes[stay], row[stay]
    return out.reshape(rows, bins)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = sketches.reshape(len(sketches), bands, rows)
    acc = mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(sketches), 0)
    for j in range(rows):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return acc


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch_batches(shingle: int, percent: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower_ascii=True)
        # a set of n elements can only link to another of n + 1 at most if n / (n + 1) reaches the threshold
        least = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 60
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = hasher.words(data, offsets)
                words = hasher.spans(hasher.sums(data), starts, ends)
                hashes, begins = shingle_hashes(words, first, shingle)
                sizes = np.diff(begins)
                sketched = np.flatnonzero(sizes >= least)
                keep = np.repeat(sizes >= least, sizes)
                inner = np.concatenate([[0], np.cumsum(sizes[sketched])])
                keys = band_keys(sketch(hashes[keep], inner, bands * rows), bands, rows)
                where = np.concatenate([[0], np.cumsum(np.where(sizes >= least, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(row_sums(mix(hashes), begins).view(np.int64)),
                        pa.array(row_sums(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), begins).view(np.int64)),
                        _lists(keys.reshape(-1), where),
                    ],
                    names=["id", "n", "d1", "d2", "bands"],
                )

    return run


def _set_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower_ascii=True)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = hasher.words(data, offsets)
                hashes, begins = shingle_hashes(hasher.spans(hasher.sums(data), starts, ends), first, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(hashes, begins)], names=["id", "members"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) that link on their full sets."""
    left, right = sets.toDF("_a", "sa"), sets.toDF("_b", "sb")
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b")


def _components(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the links between members of the same bucket: ``node, component``."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed("bucket", "_sized")
    busy = members.join(sizes, F.col("bucket") == F.col("_sized")).groupBy("id").agg(F.sum("_size").alias("_n")).withColumnRenamed("id", "_id")
    rank = F.struct((-F.col("_n")).alias("n"), F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    leaders = members.join(busy, F.col("id") == F.col("_id")).groupBy("bucket").agg(F.min(rank).alias("lead"))
    leaders = scratch.keep(leaders.withColumnRenamed("bucket", "_b"), "leaders")
    in_bucket = F.col("bucket") == F.col("_b")
    # from leader to leader's leader, as far as it goes: the comparison holds for any L, and a central one differs least
    shares = members.join(leaders, in_bucket).groupBy("id", "lead").agg(F.count(F.lit(1)).alias("times"))
    up = scratch.keep(shares.where((F.col("times") >= CLIMB) | (F.col("lead.id") == F.col("id"))).groupBy("id").agg(F.min("lead").alias("lead")), "up-0")
    step = 0
    while True:
        step += 1
        over = up.join(up.toDF("_id", "_lead"), F.col("lead.id") == F.col("_id"), "left")
        over = over.select("id", F.coalesce("_lead", "lead").alias("lead"), F.coalesce(F.col("lead") != F.col("_lead"), F.lit(False)).alias("moved"))
        over = scratch.keep(over, f"up-{step}")
        up = over.select("id", "lead")
        if not over.where("moved").take(1):
            break
    leaders = leaders.join(up.toDF("_id", "_lead"), F.col("lead.id") == F.col("_id"), "left").select("_b", F.coalesce("_lead", "lead")["id"].alias("lead"))
    led = members.join(leaders, in_bucket).where("id <> lead").select("lead", "id").distinct()
    one, other = sets.toDF("_lead", "ls"), sets.toDF("_id", "xs")
    compared = led.join(one, F.col("lead") == F.col("_lead")).join(other, F.col("id") == F.col("_id"))
    compared = compared.select("lead", "id", F.size("ls").alias("size"), F.array_except("ls", "xs").alias("gone"), F.array_except("xs", "ls").alias("new"))
    # in units of 1 / (100 + percent) common differences: what x adds to the needed number, and what L takes off
    adds = F.size("gone") * 100 + F.size("new") * percent
    compared = compared.select(
        "lead", "id", adds.alias("adds"), (F.col("size") * (100 - percent)).alias("off"),
        F.concat(F.array_sort("new"), F.array_sort("gone")).alias("diff"),
    )
    compared = scratch.keep(compared, "compared")
    scratch.release()
    tied = compared.where("adds <= off").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    apart = compared.where("adds > off").select(F.col("lead").alias("_l"), F.col("id").alias("_i"))
    left = members.join(leaders, in_bucket).join(apart, (F.col("lead") == F.col("_l")) & (F.col("id") == F.col("_i"))).select("bucket", "id")
    for turn in range(MORE_LEADERS):
        left = scratch.keep(left, f"left-{turn}")
        rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"))
        elected = left.groupBy("bucket").agg(F.min(rank)["id"].alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
        led = left.join(elected.select(F.col("bucket").alias("_b"), "lead"), in_bucket).where("id <> lead")
        led = scratch.keep(led.select("bucket", "id", "lead"), f"led-{turn}")
        if not led.take(1):
            break
        pairs = led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        found = scratch.keep(_links(pairs, sets, percent), f"tied-{turn}")
        scratch.release()
        tied = tied.union(found)
        told = (F.least("id", "lead") == F.col("a")) & (F.greatest("id", "lead") == F.col("b"))
        left = led.join(found, told, "left_anti").select("bucket", "id")
    first = connected_components(tied, scratch, "first")

    unit = 100 + percent
    rest = compared.where("adds > off")
    stray = scratch.keep(rest.select(F.col("lead").alias("_lead")).distinct(), "stray")
    in_doubt = compared.join(stray, F.col("lead") == F.col("_lead"), "left_semi")
    in_doubt = in_doubt.join(first.toDF("_node", "_comp"), F.col("id") == F.col("_node"), "left").withColumn("comp", F.coalesce("_comp", "id"))
    in_doubt = in_doubt.withColumn("n", F.size("diff"))

    # the least that a partner on either side adds, under each leader
    is_far = F.col("adds") > F.col("off")
    bounds = in_doubt.groupBy(F.col("lead").alias("_l")).agg(
        F.min(F.when(is_far, F.col("adds"))).alias("far_adds"), F.min(F.when(~is_far, F.col("adds"))).alias("near_adds"),
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
    ).where("_lo <> _hi")
    in_doubt = scratch.keep(in_doubt.join(bounds, F.col("lead") == F.col("_l")).drop("_l", "_lead", "_node", "_comp", "_lo", "_hi"), "in-doubt")

    def heads(rows: DataFrame, partner_adds: str) -> DataFrame:
        """The first differences of each row, such that any partner it can link to has one of them among its own."""
        least = F.greatest(F.lit(1), F.ceil((F.col("adds") + F.col(partner_adds) - F.col("off")) / unit).cast("int"))
        rows = rows.withColumn("_least", least).where("_least <= n")
        first = F.slice("diff", F.lit(1), F.col("n") - F.col("_least") + 1)
        each = rows.select("lead", "id", "adds", "off", "n", "comp", F.posexplode(first).alias("at", "d"))
        return each.select("lead", "id", "adds", "off", (F.col("n") - F.col("at")).alias("rest"), "comp", "d")

    def meeting(one: DataFrame, other: DataFrame, apart) -> DataFrame:
        other = other.toDF(*[f"{c}_" for c in other.columns])
        needed = F.col("adds") + F.col("adds_") - F.col("off")
        # differences stand in one order, so a pair's first common one is followed by what is left in both at most
        may_link = (F.col("comp") != F.col("comp_")) & (needed <= F.least("rest", "rest_") * unit) & apart
        found = one.join(other, (F.col("lead") == F.col("lead_")) & (F.col("d") == F.col("d_")) & may_link)
        return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"))

    far, near = in_doubt.where(is_far), in_doubt.where(~is_far)
    among = heads(far, "far_adds")
    parts = among.groupBy("lead", "d", "comp").count().groupBy(F.col("lead").alias("_l"), F.col("d").alias("_d"))
    largest = parts.agg(F.max(F.struct("count", "comp"))["comp"].alias("_largest"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    among = among.join(largest, (F.col("lead") == F.col("_l")) & (F.col("d") == F.col("_d"))).withColumn("most", F.col("comp") == F.col("_largest"))
    among = scratch.keep(among.drop("_l", "_d", "_largest", "_parts"), "among")
    scratch.release()
    pairs = meeting(among, among, ~F.col("most") & (F.col("most_") | (F.col("id") < F.col("id_"))))
    pairs = pairs.union(meeting(heads(near, "far_adds"), heads(far, "near_adds"), F.lit(True))).distinct()
    links = scratch.keep(_links(pairs, sets, percent), "links")
    scratch.release()
    if not links.take(1):
        return first
    return connected_components(links.union(first.select("node", "component")), scratch, "second")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row.

    Words are runs of other than ASCII white space, with A-Z lower-cased.  A text of fewer than ``shingle`` words
    has its whole sequence as its only shingle; without words (or null) its set is empty and linked to nothing.
    Documents link when ``100 * shared >= percent * union``; ``component_id`` is the smallest id reachable and
    ``kept`` marks the row that bears it.  Rows that repeat an id are one document: links of any of them count
    for the id.  A row without an id links to nothing (component null, kept).  An empty table gives an empty
    result.  Only the two named columns are read, so names of others cannot clash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, d1 long, d2 long, bands array<long>"
    sketches = scratch.keep(named.mapInArrow(tidy(_sketch_batches(shingle, percent, bands, rows)), schema), "sketches")

    linkable = sketches.where("n > 0 and id is not null")
    classes = scratch.keep(linkable.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    # the joins below use a key of their own, so that a class with very many copies can be split
    key = F.struct(F.col("d1").bitwiseXOR(F.col("n")).alias("x"), F.col("d2").alias("y"))
    by_key = classes.select(key.alias("_key"), "rep")
    reps = linkable.where(F.size("bands") > 0).select("id", "bands", key.alias("k"))
    reps = reps.join(by_key, F.col("k") == F.col("_key")).where("id = rep")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("bucket").alias("_open"))
    shared = scratch.keep(shared, "shared")
    members = possible(buckets, F.col("bucket"), bitmap_of(shared, F.col("_open")))
    members = scratch.keep(members.join(shared, F.col("bucket") == F.col("_open"), "left_semi").distinct(), "members")

    wanted = scratch.keep(members.select("id").distinct(), "wanted").withColumnRenamed("id", "_w")
    texts = possible(named.where("id is not null"), F.col("id"), bitmap_of(wanted, F.col("_w")))
    sets = texts.mapInArrow(tidy(_set_batches(shingle)), "id long, members array<long>")
    sets = scratch.keep(sets.join(wanted, F.col("id") == F.col("_w"), "left_semi"), "sets")

    reached = _components(scratch, members, sets, percent)

    rows_key = sketches.withColumn("k", F.when(F.col("n") > 0, key).otherwise(F.struct(F.col("id").alias("x"), F.lit(None).cast("long").alias("y"))))
    out = rows_key.select("id", "n", "k").join(by_key, (F.col("k") == F.col("_key")) & F.col("id").isNotNull(), "left")
    out = out.join(reached, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    Of a group the row with the smallest id stays.  Rows without an id, with a null or empty text, and repeated rows of
    an id that stays are kept; an empty table gives an empty one.  The operator's own columns begin with ``__cl_``, so
    other names cannot clash.
    """
    dropped = near_duplicates(docs, id_col=id_col, **settings).where("not kept").select(id_col)
    return without_ids(docs, Scratch(docs.sparkSession, "near-dropped").keep(dropped.distinct(), "ids"), id_col)
