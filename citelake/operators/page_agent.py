"""The pure parts of the page agent over tables of runs: replies, elements and steps are rows, rules are columns.

Tables share ``run, step``: ``elements`` (``pos, id, role, text, x, y``) are the controls seen at a step, ``replies`` (``reply``
as JSON text) what a model answered, ``steps`` what was done (``action, performed, url_before, url_after``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Actions, and the words and roles that the keyword planner knows; then the limits of what is shown.
ACTIONS = ["click", "type", "hover", "scroll", "stop"]
SUBMIT_WORDS = ["submit", "enter", "go", "search", "continue", "next"]
STOP_WORDS = ["done", "complete", "finished", "success"]
INPUT_ROLES = ["input", "searchbox", "textbox"]
MOST_NODES, LABEL_CHARS, LAST_STEPS, REASON_CHARS = 60, 60, 8, 200

ACTION = ["type", "x", "y", "element_id", "value", "reason", "error"]
STEP = ["run", "step"]


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _of(reply: Column, name: str) -> Column:
    return F.get_json_object(reply, f"$.{name}")


def unwrapped(reply: Column) -> Column:
    """The first of a list, and what stands below ``action`` where no type is given; null unless that is an object."""
    listed = F.startswith(F.trim(reply), F.lit("["))
    one = F.when(listed, F.get_json_object(reply, "$[0]")).otherwise(reply)
    inner = _of(one, "action")
    inside = F.startswith(F.trim(inner), F.lit("{")) & _of(one, "type").isNull()
    found = F.when(inside, inner).otherwise(one)
    return F.when(F.startswith(F.trim(found), F.lit("{")), found)


def actions(replies: DataFrame, elements: DataFrame) -> DataFrame:
    """Each reply as an action: ``run, step`` and ``ACTION``; what cannot be resolved is a stop with an error.

    An element is found by its id, else by its place, the first of several.  A null or unreadable reply is an error too.
    """
    raw = replies.select(*STEP, unwrapped(F.col("reply")).alias("_r"))
    whole = lambda name: F.expr(f"try_cast(get_json_object(_r, '$.{name}') AS double)").cast("long")
    raw = raw.select(
        *STEP, "_r", F.lower(F.trim(F.coalesce(_of(F.col("_r"), "type"), F.lit("")))).alias("_type"), _of(F.col("_r"), "id").alias("_id"),
        whole("x").alias("_x"), whole("y").alias("_y"), _of(F.col("_r"), "value").alias("_value"),
        F.nullif(F.substring(_of(F.col("_r"), "reason"), 1, REASON_CHARS), F.lit("")).alias("reason"),
    )
    seen = elements.select(*[F.col(c).alias(f"e_{c}") for c in (*STEP, "pos", "id", "x", "y")])
    by_id = F.col("_id") == F.col("e_id").cast("string")
    by_place = (F.col("_x") == F.col("e_x")) & (F.col("_y") == F.col("e_y"))
    same_step = (F.col("run") == F.col("e_run")) & (F.col("step") == F.col("e_step"))
    hits = raw.join(seen, same_step & (by_id | by_place))
    best = hits.groupBy(*STEP).agg(F.min(F.struct(F.when(by_id, 0).otherwise(1).alias("rank"), "e_pos", "e_id", "e_x", "e_y")).alias("hit"))
    found = raw.join(best, STEP, "left")
    needs_place = F.col("_type").isin("click", "type", "hover")
    error = (
        F.when(F.col("_r").isNull(), "the reply holds no action object")
        .when(~F.col("_type").isin(ACTIONS), F.concat(F.lit("no such action: "), "_type"))
        .when(needs_place & F.col("hit").isNull() & (F.col("_x").isNull() | F.col("_y").isNull()), F.concat("_type", F.lit(" without an element or a place")))
    )
    found = found.withColumn("error", error)
    acts, placed = F.col("error").isNull() & (F.col("_type") != "stop"), needs_place & F.col("hit").isNull()
    return found.select(
        *STEP,
        F.when(F.col("error").isNull(), F.col("_type")).otherwise("stop").alias("type"),
        F.when(acts, F.when(placed, F.col("_x")).otherwise(F.col("hit.e_x"))).alias("x"),
        F.when(acts, F.when(placed, F.col("_y")).otherwise(F.col("hit.e_y"))).alias("y"),
        F.when(acts, F.col("hit.e_id")).alias("element_id"),
        F.when(acts & (F.col("_type") == "type"), F.coalesce("_value", F.lit(""))).alias("value"),
        F.when(F.col("error").isNull(), F.col("reason")).alias("reason"),
        "error",
    )


def planned(goals: DataFrame, elements: DataFrame) -> DataFrame:
    """An action for each step (``run, step, goal, typed``) by keywords, without a model: ``run, step`` and ``ACTION``.

    The first element that takes input is filled, else the first that submits is pressed, else the first of all.
    Without elements the run stops, with an error unless the goal says that it is reached.
    """
    label, role = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("role", F.lit("")))
    rule = F.when(F.contains(label, F.lit("search")) | role.isin(INPUT_ROLES), 0).when(_has_any(label, SUBMIT_WORDS), 1).otherwise(2)
    first = elements.groupBy(*STEP).agg(F.min(F.struct(rule.alias("rule"), "pos", "id", "x", "y")).alias("hit"))
    reached = _has_any(F.lower(F.coalesce("goal", F.lit(""))), STOP_WORDS)
    rule = F.col("hit.rule")
    return goals.join(first, STEP, "left").select(
        *STEP,
        F.when(rule.isNull(), "stop").when(rule == 0, "type").otherwise("click").alias("type"),
        F.col("hit.x").alias("x"),
        F.col("hit.y").alias("y"),
        F.col("hit.id").alias("element_id"),
        F.when(rule == 0, F.coalesce(F.nullif("typed", F.lit("")), "goal")).alias("value"),
        F.when(rule == 0, "takes input").when(rule == 1, "submits").when(rule == 2, "first element").alias("reason"),
        F.when(rule.isNull() & ~reached, "no element to act on").alias("error"),
    )


def element_lines(elements: DataFrame) -> DataFrame:
    """What a model is shown of each step's first ``MOST_NODES`` elements: ``run, step, lines``."""
    shown = elements.withColumn("_n", F.row_number().over(Window.partitionBy(*STEP).orderBy("pos"))).where(F.col("_n") <= MOST_NODES)
    label = F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, LABEL_CHARS)
    line = F.format_string("%s [%s] %s @%s,%s", F.col("id").cast("string"), F.coalesce("role", F.lit("?")), F.to_json(F.struct(label.alias("label"))), F.col("x").cast("string"), F.col("y").cast("string"))
    return shown.groupBy(*STEP).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda r: r["line"]), "\n").alias("lines"))


def step_lines(steps: DataFrame) -> DataFrame:
    """What a model is shown of each run's last ``LAST_STEPS`` steps: ``run, lines``."""
    last = steps.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy(F.col("step").desc()))).where(F.col("_n") <= LAST_STEPS)
    moved = F.col("url_after").isNotNull() & (F.col("url_after") != F.coalesce("url_before", F.lit("")))
    line = F.concat_ws(
        " ", F.col("step").cast("string"), F.col("action.type"), F.concat(F.lit("on "), F.col("action.element_id").cast("string")),
        F.to_json(F.when(F.coalesce(F.length("action.value"), F.lit(0)) > 0, F.struct(F.col("action.value").alias("value")))),
        F.when(moved, F.concat(F.lit("-> "), "url_after")).otherwise("-> same page"),
    )
    return last.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda r: r["line"]), "\n").alias("lines"))


def outcomes(steps: DataFrame, elements: DataFrame, budget: int) -> DataFrame:
    """``run, success, error``: the first deciding step within the budget tells how a run ended.

    A stop without an error succeeds.  A stop with one, a press on nothing and an action that could not be performed fail.
    """
    counts = elements.groupBy(*STEP).agg(F.count(F.lit(1)).alias("_seen"))
    numbered = steps.join(counts, STEP, "left").withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("step")))
    stop = F.col("action.type") == "stop"
    blind = (F.col("action.type") == "click") & F.col("action.element_id").isNull() & F.col("_seen").isNull()
    error = (
        F.when(stop, F.col("action.error"))
        .when(blind, "no element to act on")
        .when(~F.coalesce("performed", F.lit(True)), F.concat(F.lit("could not perform: "), F.coalesce("action.type", F.lit("?"))))
    )
    decides = F.coalesce(stop, F.lit(False)) | error.isNotNull()
    first = F.min(F.when(decides & (F.col("_n") <= budget), F.struct("_n", F.coalesce(stop & error.isNull(), F.lit(False)).alias("success"), error.alias("error"))))
    ended = numbered.groupBy("run").agg(first.alias("_end"))
    spent = F.lit(f"no end within {budget} steps")
    return ended.select("run", F.coalesce("_end.success", F.lit(False)).alias("success"), F.when(F.col("_end").isNull(), spent).otherwise(F.col("_end.error")).alias("error"))
