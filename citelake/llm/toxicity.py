"""Toxicity by maximum-scoring segments of token log-odds.

Lexicon: words of labelled documents and their prefixes are counted in toxic and clean documents.  A feature's
share of toxic documents has a Dirichlet prior of ``prior`` pseudo-documents whose mean is the share of its next
shorter prefix (at the root, of all documents), so a rare spelling leans on its stem.  A feature's score is the
log-odds of its share against the root's.  Known are the features whose likelihood ratio against the root's share
exceeds the number of features of their length (so that chance makes few of them) and whose odds are raised
``LEAST_ODDS`` times at least.

Passages: a word scores what its longest known feature scores, any other word scores the small negative log-odds
of being no known word.  One scan over the words finds all maximal scoring segments (each is worth more than any
segment that contains or cuts it).  By extreme-value theory a clean text of n words holds about
``K n exp(-lambda S)`` segments of score S or more; lambda and K are fitted on clean documents that the lexicon
has not seen.  A segment's evidence is the negative log of that number, a document's is the sum over its
significant segments, and a logistic curve, fitted on the same unseen documents, maps it to a score.

The model is fitted on at most ``FIT_DOCS`` documents per label, drawn by hash; all else reads every document whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.codepoints import code_point_chunks, letter_tables, letters_lowered
from citelake.llm.scratch import Scratch
from citelake.llm.words import WordHasher, mix

#: Bounds of what the model is fitted on and of its size.
FIT_DOCS = 6_000
MAX_FEATURES = 20_000
PREFIXES = (3, 4, 5, 6, 7)
PRIOR = 4.0
LEAST_ODDS = 4.0
#: Every fit document whose hash falls in this share of the range calibrates; the rest make the lexicon.
CALIBRATE = 0.35
_TOP = 1e-9


def _point_hasher() -> tuple[WordHasher, np.ndarray]:
    hasher = WordHasher()
    return hasher, mix(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Spans:
    """Hashes of ranges of code points."""

    def __init__(self):
        self.hasher, self.values = _point_hasher()

    def sums(self, points: np.ndarray) -> np.ndarray:
        self.hasher._grow(len(points) + 1)
        out = np.zeros(len(points) + 1, np.uint64)
        values = self.values[np.minimum(points, len(self.values) - 1)]
        np.cumsum(values * self.hasher.powers[: len(points)], out=out[1:])
        return out

    def keys(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, whole: bool) -> np.ndarray:
        """Keys of prefixes, or of whole words, that span [start, end)."""
        return mix(self.hasher.spans(sums, start, end) + np.uint64(whole))

    def key(self, feature: str) -> int:
        whole, text = feature.endswith("$"), feature.rstrip("$")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return int(self.keys(self.sums(points), np.array([0]), np.array([len(points)]), whole)[0])


def maximal_segments(at: list[int], score: list[float], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence of words: (score, first hit, last hit).

    Word ``at[i]`` scores ``score[i]`` > 0, and every word between scores ``-gap``.  Segments on the list are told
    by the running totals before (left) and after them (right); a new one joins the nearest earlier segment whose
    left total is lower, if that one's right total is lower too, and looks again.
    """
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    total, before = 0.0, -1
    for n, (place, worth) in enumerate(zip(at, score, strict=True)):
        total -= gap * (place - before - 1)
        before = place
        left, first = total, n
        total += worth
        right = total
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j -= 1
            if j < 0 or rights[j] >= right:
                lefts.append(left)
                rights.append(right)
                spans.append((first, n))
                break
            left, first = lefts[j], spans[j][0]
            del lefts[j:], rights[j:], spans[j:]
    return [(r - x, a, b) for x, r, (a, b) in zip(lefts, rights, spans, strict=True)]


def _hits(model: dict, spans: _Spans, points: np.ndarray, offsets: np.ndarray, tables):
    """Words (starts, ends, first of each row) and the score of each (0 if not known)."""
    is_letter, lowered = letters_lowered(points, tables)
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_letter[:-1]]) if len(points) else np.zeros(0, bool)
    after = np.concatenate([is_letter[1:], [False]]) if len(points) else np.zeros(0, bool)
    starts = np.flatnonzero(is_letter & (~before | edge[:-1]))
    ends = np.flatnonzero(is_letter & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    score = np.zeros(len(starts))
    if len(model["keys"]) and len(starts):
        sums = spans.sums(lowered)
        for length in (*PREFIXES, None):
            able = np.arange(len(starts)) if length is None else np.flatnonzero(ends - starts >= length)
            stop = ends[able] if length is None else starts[able] + length
            keys = spans.keys(sums, starts[able], stop, length is None)
            likely = model["bits"][(keys >> np.uint64(44)).astype(np.int64)]
            able, keys = able[likely], keys[likely]
            place = np.minimum(np.searchsorted(model["keys"], keys), len(model["keys"]) - 1)
            known = model["keys"][place] == keys
            score[able[known]] = model["scores"][place[known]]
    return starts, ends, first, np.maximum(score, 0.0)


def _lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict:
    """Keys and scores of features from (feature, toxic documents, clean documents)."""
    root = (toxic + 0.5) / (toxic + clean + 1)
    base = math.log(root / (1 - root))
    counts = {f: (t, c) for f, t, c in rows}
    share: dict[str, float] = {}

    def posterior(feature: str) -> float:
        if feature not in share:
            stem = feature.rstrip("$")
            parents = [p for p in (stem[:k] for k in reversed(PREFIXES) if k < len(stem) or (k == len(stem) and feature.endswith("$"))) if p in counts]
            mean = posterior(parents[0]) if parents else root
            t, c = counts[feature]
            share[feature] = (t + PRIOR * mean) / (t + c + PRIOR)
        return share[feature]

    spans, keys, scores = _Spans(), [], []
    for feature in counts:
        p = posterior(feature)
        keys.append(spans.key(feature))
        scores.append(max(0.0, math.log(p / (1 - p)) - base))
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    sorted_keys = np.array(keys, np.uint64)[order]
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_keys >> np.uint64(44)).astype(np.int64)] = True
    return {"keys": sorted_keys, "scores": np.array(scores)[order], "bits": bits, "gap": 0.01, "lambda": 1.0, "K": 0.01, "a": base, "b": 0.0}


def _segments(model: dict):
    """Arrow function: each row's words and maximal segments (code points and scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, spans = letter_tables(), _Spans()
        for batch in batches:
            for a, b, points, offsets in code_point_chunks(batch.column(1).to_pylist()):
                starts, ends, first, score = _hits(model, spans, points, offsets, tables)
                hit = np.flatnonzero(score > 0)
                bounds = np.searchsorted(hit, first)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for row in np.flatnonzero(np.diff(bounds)).tolist():
                    own = hit[bounds[row] : bounds[row + 1]]
                    for worth, i, j in maximal_segments((own - first[row]).tolist(), score[own].tolist(), model["gap"]):
                        found[row].append(
                            {"start": int(starts[own[i]] - offsets[row]), "stop": int(ends[own[j]] - offsets[row]), "score": worth, "hits": j - i + 1}
                        )
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(found, kind)], names=["id", "n_words", "segments"]
                )

    return run


def find_segments(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, segments`` for every row, the segments being all maximal ones."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, segments array<struct<start:long,stop:long,score:double,hits:long>>"
    return named.mapInArrow(_segments(model), schema)


def _evidence(model: dict, n_words: float, scores: list[float]) -> float:
    each = (model["lambda"] * s - math.log(max(_TOP, model["K"] * max(1, n_words))) for s in scores)
    return sum(e for e in each if e > 0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over weighted rows, with weak pull on the slope towards 1."""
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        miss = weight * (y - p)
        grad = np.array([miss.sum() - 0.01 * a, (miss * x).sum() - 0.1 * (b - 1)])
        hess = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / max(1e-12, float(np.abs(move).max())))
        a, b = a + float(move[0]), b + float(move[1])
        if np.abs(move).max() < 1e-8:
            break
    return a, max(b, 0.0)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS
) -> dict:
    """The model, from rows of ``labels`` (id, label 0 or 1) whose documents are in ``docs``.

    Labels of each kind fall into ``fit_docs`` hashed bins and the least hash of a bin is taken.  Without labels
    of both kinds no word is known and every document gets the same low score; so it is where ``docs`` is empty.
    Rows without an id or with another label are not used.  A label told several times is drawn once; where an id has
    several texts all of them are read, and ties between equal hashes fall to the lesser id.  Only the named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    h = F.xxhash64(F.col("_i"), F.lit("fit"))
    told = labels.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y")).where("_i is not null and _y in (0, 1)")
    drawn = (
        told.groupBy("_y", F.pmod(h, F.lit(fit_docs)).alias("_bin")).agg(F.min(F.struct(h.alias("h"), F.col("_i").alias("i"))).alias("d"))
        .select("_y", F.col("d.i").alias("_i"), ((F.pmod("d.h", F.lit(1009 * fit_docs)) / fit_docs).cast("int") / 1009 < CALIBRATE).alias("late"))
    )
    chosen = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    # the drawn rows are 2 * fit_docs at most
    sample = chosen.join(F.broadcast(drawn), F.col("i") == F.col("_i")).select("i", "t", F.col("_y").alias("y"), "late")
    sample = scratch.keep(sample, "sample")
    early = sample.where("not late")
    totals = {r["y"]: r["count"] for r in early.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return _lexicon([], toxic, clean) | {"a": -4.0}
    words = early.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    stems = F.array(F.concat("w", F.lit("$")), *[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in PREFIXES])
    features = counts.select(F.explode(stems).alias("f"), "t", "c").where("f is not null").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    features = scratch.keep(features.withColumn("size", F.when(F.endswith("f", F.lit("$")), 0).otherwise(F.length("f"))), "features")
    kinds = {r["size"]: r["count"] for r in features.groupBy("size").count().collect()}
    many = F.coalesce(*[F.when(F.col("size") == size, F.lit(math.log(n + 1))) for size, n in kinds.items()], F.lit(0.0))
    base = toxic / (toxic + clean)
    share = F.col("t") / (F.col("t") + F.col("c"))
    ratio = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    telling = features.where((F.col("t") >= 2) & (F.col("t") * clean >= LEAST_ODDS * F.col("c") * toxic) & (ratio > many))
    rows = [(r["f"], r["t"], r["c"]) for r in telling.orderBy(F.desc("t"), "c", "f").limit(MAX_FEATURES).collect()]
    model = _lexicon(rows, toxic, clean)

    late = find_segments(sample.where("late"), model, "i", "t").withColumnRenamed("id", "_i")
    late = late.select("_i", "n_words", F.transform("segments", lambda s: s["score"]).alias("s"), F.aggregate("segments", F.lit(0).cast("long"), lambda x, s: x + s["hits"]).alias("hits"))
    seen = late.join(F.broadcast(drawn), "_i").select("_y", "n_words", "s", "hits").collect()  # a few numbers for each of 2 * fit_docs documents at most
    rate = {y: (sum(r["hits"] for r in seen if r["_y"] == y) + 0.5) / (sum(r["n_words"] for r in seen if r["_y"] == y) + 50) for y in (0, 1)}
    model["gap"] = max(0.01, -math.log((1 - min(0.99, rate[1])) / (1 - min(0.99, rate[0]))))
    chance = [s for r in seen if r["_y"] == 0 for s in r["s"]]
    least = min(chance, default=0.0)
    model["lambda"] = (len(chance) + 20) / (sum(s - least for s in chance) + 20)
    model["K"] = (len(chance) + 0.5) / (sum(r["n_words"] for r in seen if r["_y"] == 0) + 50) * math.exp(model["lambda"] * least)
    if {r["_y"] for r in seen} == {0, 1}:
        x = np.array([_evidence(model, r["n_words"], r["s"]) for r in seen])
        # the sample may hold the labels in other proportions than the table
        all_rows = {r["_y"]: r["count"] for r in told.groupBy("_y").count().collect()}
        drawn_rows = {y: sum(r["_y"] == y for r in seen) for y in (0, 1)}
        weight = np.array([all_rows[r["_y"]] / drawn_rows[r["_y"]] for r in seen])
        model["a"], model["b"] = _logistic(x, np.array([r["_y"] for r in seen], float), weight * len(seen) / weight.sum())
    else:
        model["a"], model["b"] = model["a"] - 2, 1.0
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_words, passages`` for every row; passages are the significant segments, in code points.

    Null and empty texts have no words and get the score of a text without evidence.  Every row is scored by itself, so
    repeated rows and ids give a row each, ties cannot occur and an empty table gives an empty result; only the named columns
    are read, so clashing names do no harm.
    """
    found = find_segments(docs, model, id_col, text_col)
    chance = F.log(F.greatest(F.lit(_TOP), F.lit(float(model["K"])) * F.greatest(F.lit(1), F.col("n_words"))))
    rated = F.transform(
        "segments",
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["hits"].alias("hits"), (s["score"] * float(model["lambda"]) - chance).alias("evidence")),
    )
    found = found.withColumn("passages", F.filter(rated, lambda s: s["evidence"] > 0))
    total = F.aggregate("passages", F.lit(0.0), lambda x, s: x + s["evidence"])
    value = 1 / (1 + F.exp(-F.least(F.lit(500.0), F.lit(float(model["a"])) + total * float(model["b"]))))
    return found.select(F.col("id").alias(id_col), value.alias("score"), "n_words", "passages")
