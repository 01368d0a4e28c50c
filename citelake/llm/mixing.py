"""Mixing sources to target weights as a time-varying curriculum.

Sources are ranked by code point (null last) and take their weight and their weight schedule in turn from
``weights`` and ``schedules``.  A source's target is its weighted share of the budget, at most ``max_repeat``
times its own size; what it cannot take is shared again by weight.  That fixed point is a water level:
``target = min(max_repeat * size, level * weight)``, and the level is the largest of the levels that follow
from taking the sources with the smallest ``size / weight`` as full, one more at a time.

Within a source, documents stand in the order of a hash of their id and text.  Token number c of a source's stream is
met at training position t, where the integral of the source's schedule up to t is c / target of the whole;
schedules are piecewise linear, so the integral is a quadratic per piece and is inverted in closed form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelake.llm.scratch import Scratch, range_buckets

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_REPEAT = 2
#: (time, weight) knots over [0, 1], in turn for the sources: falling, level, rising.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, integral before it, weight there, slope) of each piece; the whole integral is 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, done, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def position(share: Column, turn: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """Time at which the schedule number ``turn`` has spent ``share`` of its integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        at = None
        for t0, d0, w0, slope in _pieces(knots):
            rest = share - F.lit(d0)
            time = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * rest) - F.lit(w0)) / F.lit(slope)
            time = F.lit(t0) + time
            at = time if at is None else F.when(share >= F.lit(d0), time).otherwise(at)
        out = F.when(turn == k, at).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """``source, source_size`` to ``source, source_size, turn, weight, target``: one row per source."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("turn", F.col("_rank") % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    )
    full = F.col("source_size") * float(max_repeat)
    ranked = ranked.withColumn("_full", full).withColumn("_ratio", F.col("_full") / F.col("weight"))
    by_ratio = Window.orderBy("_ratio", "_rank")
    everything = Window.partitionBy()
    taken = F.coalesce(F.sum("_full").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(everything) * float(budget)
    levels = ranked.withColumn("_level", (wanted - taken) / weight_left)
    return levels.withColumn("_top", F.max("_level").over(everything)).select(
        "source",
        "source_size",
        "turn",
        "weight",
        F.least(F.col("_full"), F.col("_top") * F.col("weight")).alias("target"),
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    budget: float = BUDGET,
    max_repeat: int = MAX_REPEAT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decision for every row: ``id, source, size, source_size, target, taken, start, turn, tie``.

    ``size`` counts words (null or blank text: 0, never taken).  ``start`` is the number of the document's
    first word in its source's stream; pass k meets it again at ``start + k * source_size``, and the copy that
    crosses the target is cut there, so a source's taken words equal its target rounded down.  Rows of equal id, source
    and text stand one after the other and are interchangeable; others are told apart by a hash of the text (``tie``).
    A null id or source is one like any other.  An empty table gives an empty result.  Other columns are not read.

    Equal rows are counted first, so no group of them gathers anywhere.  The running sum over a source uses two levels:
    the order's leading hash is uniform, so equal ranges of it cut any source, however large, into even cells; cell
    sums are accumulated per source and rows within cells.  Sources themselves, one row each, are ranked in one task.
    """
    plan = _placed(docs, weights, budget, max_repeat, id_col, text_col, source_col)
    plan = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    plan = plan.withColumn("start", F.col("start") + F.col("_copy") * F.col("size"))
    room = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    for k in range(max_repeat):
        left = room - F.col("source_size") * k - F.col("start")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return plan.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "start", "turn", "tie")


def _placed(docs: DataFrame, weights, budget: float, max_repeat: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_id, source, size, source_size, target, start, turn, tie, times``: one row for all rows of equal id, source and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # an id that many rows have, or null, must not make one cell of the order, so the text's digest follows the id
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    h = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        h.alias("_h"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    rows = scratch.keep(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "rows")
    ranges = range_buckets(spark, rows.count())
    rows = rows.withColumn("_range", F.floor(F.col("_h") / float(1 << 52) * ranges).cast("int"))
    words = F.col("size") * F.col("times")
    cells = rows.groupBy("source", "_range").agg(F.sum(words).alias("_cell"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, budget, max_repeat)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_offset", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    targets = targets.withColumnRenamed("source", "_t_source")
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("_t_source"))).select(
        F.col("source").alias("_c_source"), F.col("_range").alias("_c_range"), "_offset", "source_size", "turn", "target"
    )
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_h", "_id", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    same_cell = F.col("source").eqNullSafe(F.col("_c_source")) & (F.col("_range") == F.col("_c_range"))
    placed = rows.join(cells, same_cell).withColumn("start", F.col("_offset") + F.col("_before"))
    return placed.select("_id", "source", "size", "source_size", "target", "start", "turn", "tie", "times")


def mix_report(docs: DataFrame, schedules=SCHEDULES, **settings) -> DataFrame:
    """Every document's part in the mix, range-sorted by the position of its first copy (untaken ones last)."""
    plan = plan_mix(docs, schedules=schedules, **settings)
    first = F.when(F.col("taken") > 0, position(F.col("start") / F.col("target"), F.col("turn"), schedules))
    id_col = plan.columns[0]
    return (
        plan.withColumn("first_position", F.round(first, 9))
        .select(id_col, "size", "source_size", "target", "taken", "first_position")
        .orderBy(F.col("first_position").asc_nulls_last(), id_col)
    )


def curriculum(
    docs: DataFrame,
    schedules=SCHEDULES,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_repeat: int = MAX_REPEAT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    position_col: str | None = None,
) -> DataFrame:
    """The training sequence: whole documents, once per copy whose first word the mix takes, sorted by position.

    Columns are those of ``docs`` (and ``position_col``, if named).  Documents without words carry nothing to
    train on and are left out.  Rows of equal id, source and text stand one after the other; where they differ in other
    columns, one of them (the one with the least hash of its columns) stands for all.  Null ids and sources are values
    like any other, ties in position are ordered by id, and an empty table gives an empty sequence.  The operator's own
    columns begin with ``__cl_``, so other names cannot clash.
    """
    columns = docs.columns
    plan = _placed(docs, weights, budget, max_repeat, id_col, text_col, source_col).where("size > 0")
    token = F.col("start") + F.col("__cl_pass") * F.col("source_size") + F.col("__cl_copy") * F.col("size")
    plan = plan.withColumn("__cl_pass", F.explode(F.array(*[F.lit(k) for k in range(max_repeat)])))
    plan = plan.withColumn("__cl_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).where(token < F.floor("target"))
    copies = plan.select(
        F.col("_id").alias("__cl_p_id"), F.col("source").alias("__cl_p_source"), F.col("tie").alias("__cl_p_tie"), "times",
        position(token / F.col("target"), F.col("turn"), schedules).alias("__cl_position"),
    )
    copies = Scratch(docs.sparkSession, "curriculum").keep(copies, "copies")
    tied = docs.withColumn("__cl_tie", F.xxhash64(F.col(text_col)))
    own = F.col(id_col).eqNullSafe(F.col("__cl_p_id")) & F.col(source_col).eqNullSafe(F.col("__cl_p_source")) & (F.col("__cl_tie") == F.col("__cl_p_tie"))
    held = [*columns, "__cl_position"]
    joined = tied.join(copies.where("times = 1"), own).select(held)
    several = copies.where("times > 1").select("__cl_p_id", "__cl_p_source", "__cl_p_tie", "__cl_position")
    if several.take(1):
        # of rows that are told several times one is found, by partial aggregation, before the positions are dealt to it
        repeated = tied.join(several.select("__cl_p_id", "__cl_p_source", "__cl_p_tie").distinct(), own, "left_semi")
        told = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
        one = repeated.groupBy(F.col(id_col).alias("__cl_i"), F.col(source_col).alias("__cl_s"), "__cl_tie")
        one = one.agg(F.min_by(F.struct(*columns), told).alias("__cl_row")).select("__cl_row.*", "__cl_tie")
        joined = joined.union(one.join(several, own).select(held))
    ordered = joined.orderBy("__cl_position", id_col)
    return ordered.select(*columns, *([F.col("__cl_position").alias(position_col)] if position_col else []))
