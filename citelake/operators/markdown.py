"""Pages to Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions import html


def page_markdown(pages: DataFrame, keep_comments: bool = True, loose: bool = True, repeats: bool = False) -> DataFrame:
    """``pages`` with ``markdown`` in the place of ``html``; the raw page goes no further.  ``loose`` and ``repeats`` as in :mod:`citelake.functions.html`."""

    @F.pandas_udf("string")
    def rendered(sources: pd.Series) -> pd.Series:
        return sources.map(lambda h: html.to_markdown(h, keep_comments, loose, repeats))

    return pages.select(*[c for c in pages.columns if c != "html"], rendered("html").alias("markdown"))


def page_titles(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def titled(sources: pd.Series) -> pd.Series:
        return sources.map(html.title)

    return pages.select(*[c for c in pages.columns if c != "html"], titled("html").alias("title"))
