"""Structured parts of a job as rows, and their ordered merge as joins and aggregations over these rows.

A part (``data`` as JSON, ``citations`` by pointer, ``unverified`` pointers) is told as one row for each place that objects alone
lead to, and one for each item of a list that stands there.  What merging means is then said place by place:

* the first value that is not null or empty decides the place's shape; values of another shape do not count, nor what lies
  below a place whose shape is no object;
* a list is the first one as it stands, then every item not yet in it, once; an item's citations meet at its first place;
* a scalar is the first, until one that differs and is supported comes after a part has called it unsupported;
* a value's quotes are the different ones of all parts that gave it, and it is unverified if a part said so and none cited it.

Each rule is a minimum, a union or a disjunction over ordered rows, so partial results of any tasks combine in any grouping and no
task needs a whole job.  New parts are new rows: a stream appends them, and the merge of all rows is the job's result so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.jsonx import escape, leaves
from citelake.operators.shared import written

QUOTE = "struct<quote:string,url:string>"
LEAF = f"struct<below:string,value:string,cited:boolean,doubtful:boolean,quotes:array<{QUOTE}>>"
PLACES = f"path string, above array<string>, pos int, kind string, item int, again boolean, same string, value string, leaves array<{LEAF}>"
_QUOTE = pa.struct([("quote", pa.string()), ("url", pa.string())])
_LEAF = pa.struct([("below", pa.string()), ("value", pa.string()), ("cited", pa.bool_()), ("doubtful", pa.bool_()), ("quotes", pa.list_(_QUOTE))])
_ARROW = {
    "path": pa.string(), "above": pa.list_(pa.string()), "pos": pa.int32(), "kind": pa.string(), "item": pa.int32(), "again": pa.bool_(),
    "same": pa.string(), "value": pa.string(), "leaves": pa.list_(_LEAF),
}
#: What a place can hold; ``item`` is an item of the list at the place.
EMPTY, SCALAR, LIST, OBJECT, ITEM = "empty", "scalar", "list", "object", "item"


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _same(value) -> str:
    """Scalars that compare equal bear one name, as numbers and truth values do."""
    if isinstance(value, str):
        return "s" + value
    return "n" + (str(int(value)) if value == value and abs(value) != float("inf") and value == int(value) else repr(value))


def places(data, citations: dict, doubtful: set[str]) -> list[dict]:
    """The rows of one part, in document order."""
    out: list[dict] = []

    def told(path: str, value) -> list[dict]:
        return [
            {"below": below, "value": _text(leaf), "cited": path + below in citations, "doubtful": path + below in doubtful, "quotes": citations.get(path + below) or []}
            for below, leaf in leaves(value)
        ]

    def add(path: str, above: list[str], kind: str, value=None, item: int = -1, again: bool = False, same: str = "", held: list | None = None) -> None:
        out.append({"path": path, "above": above, "pos": len(out), "kind": kind, "item": item, "again": again, "same": same, "value": value, "leaves": held or []})

    def walk(value, path: str, above: list[str]) -> None:
        if value is None or value == "":
            add(path, above, EMPTY, _text(value))
        elif isinstance(value, dict):
            add(path, above, OBJECT)
            for key, inner in value.items():
                walk(inner, f"{path}/{escape(str(key))}", [*above, path])
        elif isinstance(value, list):
            add(path, above, LIST)
            seen: set[str] = set()
            for n, item in enumerate(value):
                same = json.dumps(item, sort_keys=True, ensure_ascii=False)
                add(path, above, ITEM, _text(item), n, same in seen, same, told(f"{path}/{n}", item))
                seen.add(same)
        else:
            add(path, above, SCALAR, _text(value), same=_same(value), held=told(path, value))

    walk(data, "", [])
    return out


def place_rows(parts: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows ``key, at, path, above, pos, kind, item, again, same, value, leaves`` of parts (``key``, the ``order`` columns, ``data,
    citations, unverified``); ``at`` is the part's place in the order.  Works on streams too."""

    told = parts.select(F.col(key).alias("key"), F.struct(*order).alias("at"), "data", "citations", "unverified")
    kinds = {name: told.schema[name].dataType.simpleString() for name in ("key", "at")}
    return told.mapInArrow(_cut, f"key {kinds['key']}, at {kinds['at']}, {PLACES}")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, citations, unverified = (batch.column(n).to_pylist() for n in (2, 3, 4))
        rows, of = [], []
        for n, (d, c, u) in enumerate(zip(data, citations, unverified, strict=True)):
            found = places(json.loads(d) if d else None, {p: q or [] for p, q in c or ()}, set(u or ()))
            rows += found
            of += [n] * len(found)
        at = pa.array(of, pa.int64())
        columns = [pa.array([r[name] for r in rows], kind) for name, kind in _ARROW.items()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["key", "at", *_ARROW])


def _on(*names: str) -> Column:
    """Equality of the named columns with those of the same names and a leading underscore."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return out


def _renamed(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumnsRenamed({name: f"_{name}" for name in names})


def _shapes(rows: DataFrame) -> DataFrame:
    """``key, path, shape, since, first, blank`` of the places that count: their shape, the part that gave it, the place's first
    appearance in document order, and what it holds while all values are empty."""
    real = F.col("kind").isin(SCALAR, LIST, OBJECT)
    found = rows.where(F.col("kind") != ITEM).groupBy("key", "path", "above").agg(
        F.min_by(F.when(real, F.col("kind")), F.when(real, F.col("at"))).alias("shape"),
        F.min(F.when(real, F.col("at"))).alias("since"),
        F.min(F.struct("at", "pos")).alias("first"),
        F.max_by("value", "at").alias("blank"),
        F.bool_or(F.col("kind") == OBJECT).alias("entered"),
    )
    found = written(found, "shapes")
    closed = found.where(F.col("entered") & (F.col("shape") != OBJECT)).select(F.col("key").alias("_key"), F.col("path").alias("_path"))
    if not closed.take(1):
        return found.drop("above", "entered")
    lost = found.select("key", "path", F.explode("above").alias("up")).join(closed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_path")), "left_semi")
    lost = lost.select(F.col("key").alias("_key"), F.col("path").alias("_path")).distinct()
    return written(found.join(lost, _on("key", "path"), "left_anti").drop("above", "entered"), "counting")


def _scalars(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """The scalar rows that give each place its last value: ``key, path, at, place, value, leaves``.

    A value lasts until a supported one that differs follows the part that left it unsupported.  Each round finds that end
    for all places at once; only places that moved on are asked again.
    """
    own = _renamed(shapes.where(F.col("shape") == SCALAR).select("key", "path", "since"), "key", "path")
    events = rows.where(F.col("kind") == SCALAR).join(own, _on("key", "path")).drop("_key", "_path")
    events = events.select("key", "path", "at", "since", "same", "value", F.col("leaves")[0].alias("leaf"))
    events = written(events.select("*", F.col("leaf.cited").alias("cited"), F.col("leaf.doubtful").alias("doubtful")), "events")
    now = events.where(F.col("at") == F.col("since")).select("key", "path", "since", F.col("same").alias("value"))
    settled, live = None, events.drop("since", "value", "leaf")
    while True:
        held = live.join(_renamed(now, "key", "path"), _on("key", "path")).where(F.col("at") >= F.col("since"))
        is_it = F.col("same") == F.col("value")
        doubt = held.groupBy("key", "path", "value", "since").agg(
            F.min(F.when(is_it & F.col("doubtful") & ~F.col("cited"), F.col("at"))).alias("doubted"), F.min(F.when(is_it & F.col("cited"), F.col("at"))).alias("proven")
        )
        doubt = doubt.where("doubted is not null and (proven is null or doubted < proven)").select("key", "path", F.col("value").alias("was"), "doubted")
        after = live.join(_renamed(doubt, "key", "path"), _on("key", "path")).where((F.col("at") > F.col("doubted")) & ~F.col("doubtful") & (F.col("same") != F.col("was")))
        moved = written(after.groupBy("key", "path").agg(F.min("at").alias("since"), F.min_by("same", "at").alias("value")), "moved")
        rest = now.join(_renamed(moved.select("key", "path"), "key", "path"), _on("key", "path"), "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        if not moved.take(1):
            break
        now = moved
        begun = _renamed(moved.select("key", "path", F.col("since").alias("from")), "key", "path")
        live = written(live.join(begun, _on("key", "path")).where(F.col("at") >= F.col("from")).select(live.columns), "live")
    last = _renamed(settled.withColumnRenamed("value", "is").withColumnRenamed("since", "begun"), "key", "path")
    events = events.join(last, _on("key", "path")).where((F.col("same") == F.col("is")) & (F.col("at") >= F.col("begun")))
    return events.select("key", "path", "at", F.lit(None).cast("int").alias("place"), "value", F.array("leaf").alias("leaves"))


def _items(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """The item rows of lists with the place in the merged list where each belongs."""
    lists = _renamed(shapes.where(F.col("shape") == LIST).select("key", "path", "since"), "key", "path")
    items = rows.where(F.col("kind") == ITEM).join(lists, _on("key", "path")).drop("_key", "_path")
    items = written(items.select("key", "path", "at", "since", "item", "again", "same", "value", "leaves"), "items")
    head = F.col("at") == F.col("since")
    firsts = items.groupBy("key", "path", "same").agg(F.min(F.struct("at", "item")).alias("first"))
    # places: the first list as it stands, then the new items of each later part, counted part by part
    own = items.where(head).select("key", "path", "at", "item", "same")
    new = firsts.join(_renamed(lists.withColumnsRenamed({"_key": "key", "_path": "path"}), "key", "path"), _on("key", "path")).where(F.col("first.at") > F.col("since"))
    taken = written(own.unionByName(new.select("key", "path", F.col("first.at").alias("at"), F.col("first.item").alias("item"), "same")), "taken")
    sizes = taken.groupBy("key", "path", "at").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("key", "path", "at", (F.sum("n").over(Window.partitionBy("key", "path").orderBy("at")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("key", "path", "at").orderBy("item")) - 1
    placed = taken.withColumn("inside", inside).join(_renamed(before, "key", "path", "at"), _on("key", "path", "at"))
    placed = written(placed.select("key", "path", "at", "item", "same", (F.col("base") + F.col("inside")).cast("int").alias("place")), "placed")
    meet = _renamed(placed.groupBy("key", "path", "same").agg(F.min("place").alias("place")), "key", "path", "same")
    later = items.where(~head).join(meet, _on("key", "path", "same")).drop("_key", "_path", "_same")
    by_item = _renamed(placed.select("key", "path", "at", "item", "place"), "key", "path", "at", "item")
    first = items.where(head).join(by_item, _on("key", "path", "at", "item")).drop("_key", "_path", "_at", "_item")
    return first.unionByName(later).select("key", "path", "at", "place", "value", "leaves", "item")


def merged_values(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge of place rows: values (``key, path, first, shape, place, value``) and leaves (``key, pointer, value, quotes, cited, unverified``)."""
    rows = written(rows, "places")
    shapes = _shapes(rows)
    scalars, items = _scalars(rows, shapes), _items(rows, shapes)
    cells = written(scalars.withColumn("item", F.lit(-1)).unionByName(items), "cells")
    pointer = F.concat("path", F.coalesce(F.concat(F.lit("/"), F.col("place").cast("string")), F.lit("")), F.col("leaf.below"))
    told = cells.select("key", "at", "item", "path", "place", F.explode("leaves").alias("leaf")).withColumn("pointer", pointer)
    told = told.select("key", "pointer", F.struct("at", "item").alias("by"), "leaf.value", "leaf.cited", "leaf.doubtful", "leaf.quotes")
    states = told.groupBy("key", "pointer").agg(F.min_by("value", "by").alias("value"), F.bool_or("cited").alias("cited"), F.bool_or("doubtful").alias("doubtful"))
    each = told.select("key", "pointer", "by", F.posexplode("quotes").alias("n", "quote"))
    each = each.groupBy("key", "pointer", "quote").agg(F.min(F.struct("by", "n")).alias("by"))
    kept = each.groupBy("key", "pointer").agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "quote"))), lambda x: x["quote"]).alias("quotes"))
    found = states.join(_renamed(kept, "key", "pointer"), _on("key", "pointer"), "left")
    none = F.array().cast(f"array<{QUOTE}>")
    pointers = found.select("key", "pointer", "value", F.coalesce("quotes", none).alias("quotes"), "cited", (F.col("doubtful") & ~F.col("cited")).alias("unverified"))
    values = cells.groupBy("key", "path", "place").agg(F.min_by("value", F.struct("at", "item")).alias("value"))
    values = shapes.select("key", "path", "shape", "first", "blank").join(_renamed(values, "key", "path"), _on("key", "path"), "left")
    shape = F.coalesce("shape", F.lit(EMPTY))
    return values.select("key", "path", "first", shape.alias("shape"), "place", F.coalesce("value", F.when(F.col("shape").isNull(), F.col("blank"))).alias("value")), pointers


def merged_leaves(parts: DataFrame, key: str, *order: str) -> DataFrame:
    """``key, pointer, value, quotes, cited, unverified`` for every leaf of each key's merged data (``value`` as JSON).

    Parts are rows of ``key``, the ``order`` columns, ``data`` (JSON), ``citations`` (pointer to quotes) and ``unverified`` (pointers); their
    order must be total within a key.  Null data gives nothing, an empty table an empty result.
    """
    return merged_values(place_rows(parts, key, *order))[1].withColumnRenamed("key", key)


def _document(found: list[tuple[str, str, str | None, list[str]]]) -> str:
    """The JSON text of places in the order of their first appearance (parents come before what is in them)."""
    root: dict = {}
    at: dict[str, dict] = {}
    for path, shape, value, items in found:
        own = {} if shape == OBJECT else [json.loads(item) for item in items] if shape == LIST else json.loads(value or "null")
        up, _, name = path.rpartition("/")
        if path == "":
            root = own
        else:
            at[up][name.replace("~1", "/").replace("~0", "~")] = own
        if shape == OBJECT:
            at[path] = own
    return _text({} if root is None else root)


def merge(parts: DataFrame, key: str, *order: str) -> DataFrame:
    """``key, data, citations, unverified, schema_errors``: each key's merged result as one row, so for jobs whose result fits one.

    ``parts`` may have ``schema_errors``, which are put after each other.  :func:`merged_leaves` gives the same as rows.
    """
    values, pointers = merged_values(place_rows(parts, key, *order))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))), lambda x: x["value"])
    told = values.groupBy("key", "path", "first", "shape").agg(F.min("value").alias("value"), items.alias("items"))
    told = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "path", "shape", "value", "items"))).alias("found"))

    @F.pandas_udf("string")
    def document(found: pd.Series) -> pd.Series:
        return found.map(lambda rows: _document([(r["path"], r["shape"], r["value"], list(r["items"])) for r in rows]))

    plain = F.transform("found", lambda x: F.struct(x["path"].alias("path"), x["shape"].alias("shape"), x["value"].alias("value"), x["items"].alias("items")))
    told = told.select("key", document(plain).alias("data"))
    by_key = pointers.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cited"), F.struct("pointer", "quotes")))).alias("citations"),
        F.array_sort(F.collect_list(F.when(F.col("unverified"), F.col("pointer")))).alias("unverified"),
    )
    errors = parts.groupBy(F.col(key).alias("_key2")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.coalesce("schema_errors", F.array().cast("array<string>")).alias("e")))), lambda x: x["e"])).alias("schema_errors"))
    out = told.join(_renamed(by_key, "key"), _on("key"), "left").join(errors, F.col("key").eqNullSafe(F.col("_key2")))
    return out.select(
        F.col("key").alias(key), "data", F.coalesce("citations", F.create_map().cast(f"map<string,array<{QUOTE}>>")).alias("citations"),
        F.coalesce("unverified", F.array().cast("array<string>")).alias("unverified"), "schema_errors",
    )

