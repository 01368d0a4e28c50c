"""Extraction scores over fixtures."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions import jsonx, scoring
from citelake.operators.files import write_text

_FORM = "struct<text:string,number:double,numeric:boolean>"
CELLS = f"array<struct<gold_at:int,guess_at:int,field:string,wanted:{_FORM},given:{_FORM}>>"


def cell_rows(fixtures: DataFrame) -> DataFrame:
    """Rows (``fixture, task, gold, data`` as JSON texts) as one row for each record and field; a fixture without any
    keeps one row with null cells.  Only the pairing of records within a fixture runs in Python."""

    @F.pandas_udf(CELLS)
    def paired(task: pd.Series, gold: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for t, g, d in zip(task, gold, data, strict=True):
            asked = json.loads(t)
            out.append(scoring.cells(jsonx.loads_lenient(d), json.loads(g), asked["records_field"], asked["key"], asked["fields"]))
        return pd.Series(out)

    kept = [c for c in fixtures.columns if c not in ("task", "gold", "data")]
    cells = fixtures.withColumn("_cells", paired("task", "gold", "data"))
    return cells.select(*kept, F.explode_outer("_cells").alias("_cell")).select(*kept, "_cell.*")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and their harmonic mean; 0 where undefined."""
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    f1 = _share(2 * precision * recall, precision + recall)
    return {name: F.round(rate, 4) for name, rate in (("precision", precision), ("recall", recall), ("f1", f1))}


def score_fixtures(fixtures: DataFrame) -> DataFrame:
    """Rows (``fixture, task, gold, data`` as JSON texts) with their scores: sums over their cells."""
    kept = [c for c in fixtures.columns if c not in ("task", "gold", "data")]
    given, wanted = F.col("given.text") != "", F.col("wanted.text") != ""
    near = F.abs(F.col("given.number") - F.col("wanted.number")) < scoring.TOLERANCE
    same = F.when(F.col("wanted.numeric"), F.coalesce(near, F.lit(False))).otherwise(F.col("given.text") == F.col("wanted.text"))
    hit = F.col("gold_at").isNotNull() & given & wanted & same
    records = cell_rows(fixtures).groupBy(*kept).agg(
        F.count_if(hit).alias("tp"),
        F.count_if(~hit & given).alias("fp"),
        F.count_if(~hit & wanted).alias("fn"),
        F.count_distinct("gold_at").alias("gold_records"),
        F.count_distinct("guess_at").alias("predicted_records"),
        F.count_distinct(F.when(F.col("guess_at").isNotNull(), F.col("gold_at"))).alias("matched_records"),
        F.count_distinct(F.when(F.col("gold_at").isNull(), F.col("guess_at"))).alias("invented_records"),
    )
    found = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    counts = ["gold_records", "predicted_records", "matched_records", "invented_records"]
    return records.select(*kept, "tp", "fp", "fn", *[rate.alias(name) for name, rate in found.items()], *counts)


def summarise(scores: DataFrame) -> DataFrame:
    """One row: micro and macro scores, and where their columns are there, reliability, latency and cost."""
    micro = rates(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn")))
    out = [F.count(F.lit(1)).alias("fixtures"), *[rate.alias(name) for name, rate in micro.items()]]
    out += [F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.coalesce(F.sum("invented_records"), F.lit(0)).alias("invented_records")]
    there = set(scores.columns)
    if "schema_valid" in there:
        out.append(F.round(F.coalesce(F.avg(F.col("schema_valid").cast("int")), F.lit(0.0)), 4).alias("schema_valid_rate"))
    if {"fields_verified", "fields_unverified"} <= there:
        good, bad = F.sum("fields_verified"), F.sum("fields_unverified")
        out.append(F.round(F.coalesce(_share(good, good + bad), F.lit(0.0)), 4).alias("citation_verified_rate"))
    if "latency_s" in there:
        out += [nearest_rank("latency_s", q).alias(f"latency_p{int(q * 100)}_s") for q in (0.5, 0.95)]
    if "estimated_input_tokens" in there:
        out.append(F.sum("estimated_input_tokens").alias("estimated_input_tokens"))
    if "error" in there:
        out.append(F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"))
    return scores.agg(*out)


def nearest_rank(column: str, share: float) -> Column:
    """The nearest-rank percentile of a numeric column, an aggregate."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")


def report(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """The summary's row and the fixtures' rows as one Markdown text: ``value``.  Fixtures are a few hundred rows at most."""
    totals = F.concat_ws("\n", *[F.concat(F.lit(f"* {c.replace('_', ' ')}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns])
    shown = [c for c in ("fixture", "precision", "recall", "f1", "tp", "fp", "fn", "matched_records", "invented_records") if c in scores.columns]
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown])
    lines = scores.agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), line, F.lit(" |")))).alias("_lines"))
    head = f"\n\n## By fixture\n\n| {' | '.join(c.replace('_', ' ') for c in shown)} |\n|{'-|' * len(shown)}\n"
    return summary.select(totals.alias("_totals")).join(lines).select(
        F.concat(F.lit("# Scores of extraction\n\n"), "_totals", F.lit(head), F.array_join("_lines", "\n"), F.lit("\n")).alias("value")
    )


def write_report(summary: DataFrame, scores: DataFrame, folder: str) -> None:
    """``scores.json`` (a line for each fixture), ``summary.json`` and ``report.md`` below ``folder``."""
    scores.coalesce(1).write.mode("overwrite").json(f"{folder}/scores.json")
    summary.write.mode("overwrite").json(f"{folder}/summary.json")
    write_text(report(summary, scores), f"{folder}/report.md")
