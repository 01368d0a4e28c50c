"""Dense vectors of chunks by a provider; the engine itself has no model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Where vectors come from: one for each text, or an error."""

    width: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ReplayEmbedder:
    """Vectors out of a mapping by text; a text that it does not hold is an error."""

    def __init__(self, vectors: dict[str, list[float]], width: int):
        self.vectors, self.width = vectors, width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.vectors[t] for t in texts]


#: Texts that a provider is asked for at a time.
BATCH = 64


def embedded(chunks: DataFrame, embedder: Embedder | None, key: str = "url", text: str = "chunk", order: str = "chunk_index", batch: int = BATCH) -> DataFrame:
    """``chunks`` with their ``vector``, for those keys whose chunks all got one.

    A key's chunks are asked for in order, ``batch`` at a time, and its vectors are taken all or none: where the provider fails, gives another
    number of vectors, or one of another width, none of that key's chunks is returned; no vector is ever made up.
    Without a provider the result is empty.
    """
    with_vector = chunks.withColumn("vector", F.lit(None).cast("array<double>"))
    if embedder is None:
        return with_vector.limit(0)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        try:
            texts = group[text].tolist()
            found = [list(map(float, v)) for at in range(0, len(texts), batch) for v in embedder.embed(texts[at : at + batch])]
        except Exception:  # noqa: BLE001  whatever a provider raises means that there are no vectors
            found = []
        if len(found) != len(group) or any(len(v) != embedder.width for v in found):
            return group.iloc[:0].assign(vector=pd.Series(dtype=object))
        return group.assign(vector=found)

    return chunks.groupBy(key).applyInPandas(whole, with_vector.schema)


def stored_counts(pages: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """What the stores took of each page: ``url, entities, triples, vectors``, counted after their checks, not before.

    ``pages`` (``url, entities, triples``) count named entities and relations whose predicate is a relationship type and
    whose ends have names; ``points`` (``url, vector``) count only if all of the page's vectors have ``width`` elements.
    """
    from citelake.functions.text import relationship_type

    named = F.filter("entities", lambda e: F.trim(e["name"]) != "")
    typed = F.filter("triples", lambda t: relationship_type(t["predicate"]).isNotNull() & (F.trim(t["subject"]) != "") & (F.trim(t["object"]) != ""))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    taken = pages.groupBy("url").agg(F.sum(size(named)).alias("entities"), F.sum(size(typed)).alias("triples"))
    right = F.coalesce(F.size("vector") == width, F.lit(False))
    whole = points.groupBy(F.col("url").alias("_url")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(right).alias("_right"))
    joined = taken.join(whole, F.col("url") == F.col("_url"), "left")
    return joined.select("url", "entities", "triples", F.coalesce(F.when(F.col("_n") == F.col("_right"), F.col("_n")), F.lit(0).cast("long")).alias("vectors"))
