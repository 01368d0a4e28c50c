"""Screens of devices: the layout dump of a screen as its elements."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions.text import bounds

NODES = "array<struct<text:string,resource_id:string,class:string,bounds:string,clickable:boolean,checkable:boolean>>"


def listed(dump: str | None) -> list[dict]:
    """A dump's nodes that can be pressed, take the focus or show text; none where it is no layout or does not parse."""
    if not dump or "<hierarchy" not in dump:
        return []
    try:
        nodes = [node.attrib for node in ET.fromstring(dump.strip()).iter("node")]
    except ET.ParseError:
        return []
    rows = [
        {
            "text": (given.get("text") or "").strip(), "resource_id": given.get("resource-id", ""), "class": given.get("class", ""), "bounds": given.get("bounds", ""),
            "clickable": given.get("clickable") == "true", "checkable": given.get("checkable") == "true", "focus": given.get("focusable") == "true",
        }
        for given in nodes
    ]
    return [{k: v for k, v in row.items() if k != "focus"} for row in rows if row["clickable"] or row["focus"] or row["text"]]


def elements(dump: Column) -> Column:
    """A column of dumps as arrays of elements with their corners and centre."""

    @F.pandas_udf(NODES)
    def parsed(dumps: pd.Series) -> pd.Series:
        return dumps.map(listed)

    def placed(node: Column) -> Column:
        box = bounds(node["bounds"])
        kept = [node[c].alias(c) for c in ("text", "resource_id", "class", "clickable", "checkable")]
        return F.struct(*kept, *[box[c].alias(c) for c in ("x1", "y1", "x2", "y2", "x", "y")])

    return F.transform(parsed(dump), placed)
