"""The package's functions under names that SQL can call."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citelake.functions import html, jsonx
from citelake.functions.text import fold, fold_value


def register(spark: SparkSession) -> list[str]:
    """Register the functions with ``spark`` and return their names."""

    def text_function(of):
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(of)

        return run

    def lenient(raw):
        value = jsonx.loads_lenient(raw)
        return None if value is None else json.dumps(value, ensure_ascii=False)

    @F.pandas_udf("array<string>")
    def extract_links(sources: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([html.links(h, u) for h, u in zip(sources, urls, strict=True)])

    @F.pandas_udf("array<struct<pointer:string,value:string>>")
    def leaf_pointers(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"pointer": p, "value": v if isinstance(v, str) else json.dumps(v)} for p, v in jsonx.leaves(jsonx.loads_lenient(t))]
        )

    found = {
        "html_to_markdown": text_function(html.to_markdown),
        "html_title": text_function(html.title),
        "normalize_text": text_function(lambda t: fold(t or "")),
        "normalize_value": text_function(fold_value),
        "loads_lenient": text_function(lenient),
        "infer_json_schema": text_function(lambda t: json.dumps(jsonx.infer_text(t))),
        "normalize_pointer": text_function(jsonx.pointer),
        "extract_links": extract_links,
        "leaf_pointers": leaf_pointers,
    }
    for name, function in found.items():
        spark.udf.register(name, function)
    return sorted(found)
