"""Structured extraction over DataFrames: windows, replies, citation checks and ordered merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions import citations, jsonx
from citelake.functions.knowledge import parse_knowledge
from citelake.operators.merging import merge
from citelake.operators.quotes import folded
from citelake.operators.shared import written
from citelake.schemas import KNOWLEDGE, QUOTE

MOST_RETRIES = 1
#: A reply as rows: its data, the data's leaves, the quotes it offers for them, and what does not fit the schema.
REPLY = (
    "data STRING, leaves ARRAY<STRUCT<pointer:STRING,value:STRING,folded:STRING>>,"
    " offered ARRAY<STRUCT<pointer:STRING,quote:STRING,folded:STRING>>, schema_errors ARRAY<STRING>"
)
REPLY_COLUMNS = ("data", "leaves", "offered", "schema_errors")


class Provider(Protocol):
    """Where model replies come from; the engine itself calls no model."""

    def complete(self, prompt: str) -> str | None: ...


class ReplayProvider:
    """Replies out of a table, by prompt."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def complete(self, prompt: str) -> str | None:
        return self.replies.get(prompt)


def window_table(pages: DataFrame, budget: int, most: int | None = None) -> DataFrame:
    """``url, window, text`` for pages (``url, markdown``): all windows of a page, or its first ``most``."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: citations.windows(t, budget, most=len(t or "") + 1 if most is None else most))

    return pages.select("url", F.posexplode(cut("markdown")).alias("window", "text"))


def knowledge(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``replies`` with the columns of a knowledge result."""

    @F.pandas_udf(KNOWLEDGE)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_knowledge(r) for r in raw], columns=["entities", "triples", "topics", "summary"])

    return replies.withColumn("_k", parsed(column)).select(*replies.columns, "_k.*")


def _reply(data, offered, errors: list[str]) -> tuple:
    return json.dumps(data, ensure_ascii=False), citations.leaf_rows(data), citations.offered_rows(offered), errors


def supported(rows: DataFrame, page: str, url: str) -> DataFrame:
    """``rows`` whose reply columns are replaced by the structured result: each leaf's quotes that the page holds, and the leaves without any.

    A leaf without such a quote is still supported if its own value is long enough and on the page.  Every leaf is in
    exactly one of ``citations`` and ``unverified``.
    """
    at_url = F.coalesce(F.col(url), F.lit(""))
    held = F.filter("offered", lambda o: (o["folded"] != "") & F.contains("_page", o["folded"]))

    def evidence(leaf: Column) -> Column:
        own = F.array_distinct(F.transform(F.filter("_held", lambda o: o["pointer"] == leaf["pointer"]), lambda o: o["quote"]))
        shown = (F.length(leaf["folded"]) >= citations.SELF_EVIDENT_CHARS) & F.contains("_page", leaf["folded"])
        found = F.when(F.size(own) > 0, own).when(shown, F.array(leaf["value"])).otherwise(F.array().cast("array<string>"))
        return F.struct(leaf["pointer"].alias("pointer"), F.transform(found, lambda q: F.struct(q.alias("quote"), at_url.alias("url"))).alias("quotes"))

    told = rows.withColumn("_page", folded(page)).withColumn("_held", held).withColumn("_leaves", F.transform("leaves", evidence))
    cited = F.map_from_entries(F.filter("_leaves", lambda x: F.size(x["quotes"]) > 0)).cast(f"map<string,array<{QUOTE}>>")
    missing = F.transform(F.filter("_leaves", lambda x: F.size(x["quotes"]) == 0), lambda x: x["pointer"])
    keep = [c for c in rows.columns if c not in REPLY_COLUMNS]
    return told.select(*keep, "data", cited.alias("citations"), missing.alias("unverified"), "schema_errors")


def verify_replies(rows: DataFrame, schema: dict | None = None) -> DataFrame:
    """Rows with ``url, page, reply`` and the structured result that the reply gives: its data, the quotes that the page
    holds, the values that nothing supports, and what does not fit ``schema``.  An unusable reply gives an empty one."""

    @F.pandas_udf(REPLY)
    def read(reply: pd.Series) -> pd.DataFrame:
        out = []
        for r in reply:
            data, offered = citations.unwrap_reply(jsonx.loads_lenient(r))
            out.append(_reply(data or {}, offered, jsonx.schema_errors(data, schema) if schema and data is not None else []))
        return pd.DataFrame(out, columns=list(REPLY_COLUMNS))

    return supported(rows.withColumn("_r", read("reply")).select(*rows.columns, "_r.*"), "page", "url")


def first_windows(windows: DataFrame, most: int = 4) -> DataFrame:
    """The first ``most`` windows of each page (at least one) for ``extract``, with the page's ``windows_skipped``."""
    most = max(1, most)
    totals = windows.groupBy(F.col("url").alias("_url")).agg(F.greatest(F.max("window") + 1 - most, F.lit(0)).alias("windows_skipped"))
    return windows.where(F.col("window") < most).join(totals, F.col("url").eqNullSafe(F.col("_url"))).drop("_url")


def extract(windows: DataFrame, provider: Provider, instruction: str, schema: dict) -> DataFrame:
    """``url, window`` and the structured result of each window; a reply that breaks the schema is asked for once more,
    with the errors, and the second is used if it has no more of them."""
    jsonx.validate_schema(schema)

    def ask(prompt: str):
        data, offered = citations.unwrap_reply(jsonx.loads_lenient(provider.complete(prompt)))
        return data, offered, jsonx.schema_errors(data, schema) if data is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, window, text in zip(batch["url"], batch["window"], batch["text"], strict=True):
                prompt = citations.build_prompt(text, instruction, schema, url)
                data, offered, errors = ask(prompt)
                if errors:
                    again = ask(prompt + "\nThe last answer did not fit the schema:\n" + "\n".join(errors))
                    if again[0] is not None and len(again[2]) <= len(errors):
                        data, offered, errors = again
                out.append((url, window, text, *_reply(data or {}, offered, errors)))
            yield pd.DataFrame(out, columns=["url", "window", "text", *REPLY_COLUMNS])

    replies = windows.select("url", "window", "text").mapInPandas(run, f"url STRING, window INT, text STRING, {REPLY}")
    return supported(replies, "text", "url").drop("text")


def extract_pages(pages: DataFrame, provider: Provider, instruction: str, schema: dict, budget: int = 6000, most: int = 4) -> DataFrame:
    """``url``, the structured result of each page (``url, markdown``), ``windows`` asked for and ``windows_skipped``.

    A page's windows are extracted and folded in order; where there were several, the folded data is held against the
    schema anew, since parts that fit need not fit together.
    """
    asked = written(first_windows(window_table(pages, budget), most), "windows")
    parts = extract(asked, provider, instruction, schema)
    counts = asked.groupBy(F.col("url").alias("_url")).agg(F.count(F.lit(1)).cast("int").alias("windows"), F.max("windows_skipped").alias("windows_skipped"))

    @F.pandas_udf("array<string>")
    def checked(data: pd.Series) -> pd.Series:
        return data.map(lambda text: jsonx.schema_errors(json.loads(text), schema))

    merged = merge(parts, "url", "window").join(counts, F.col("url") == F.col("_url"))
    errors = F.when(F.col("windows") > 1, checked("data")).otherwise(F.col("schema_errors"))
    return merged.select("url", "data", "citations", "unverified", errors.alias("schema_errors"), "windows", "windows_skipped")


def leaf_table(rows: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``id, position, pointer, value`` for the leaves of a JSON column, in document order; text that is no JSON has none."""

    @F.pandas_udf("array<struct<pointer:string,value:string>>")
    def found(texts: pd.Series) -> pd.Series:
        def of(text):
            value = jsonx.loads_lenient(text)
            return [{"pointer": p, "value": v if isinstance(v, str) else json.dumps(v)} for p, v in jsonx.leaves(value)]

        return texts.map(of)

    return rows.select(id_col, F.posexplode(found(json_col)).alias("position", "leaf")).select(id_col, "position", "leaf.pointer", "leaf.value")
