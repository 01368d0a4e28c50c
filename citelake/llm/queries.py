"""The registered queries of this subpackage, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import lang_id, sp_encode, token_counts, toxicity
from citelake.llm.exact_dedup import exact_dedup
from citelake.llm.filter_audit import audit
from citelake.llm.fingerprints import compare_with_edits
from citelake.llm.line_dedup import group_lines
from citelake.llm.mixing import mix_report
from citelake.llm.near_dedup import near_duplicates
from citelake.llm.ngram_join import ngram_join
from citelake.llm.periodic_runs import periodic_runs, repeat_tail
from citelake.llm.sharding import shard_records

#: Vocabulary files; the operators take any path.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = _remainder("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_words", "passages")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=2)


def _remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = _remainder("doc_id", 5) == 0
    model = lang_id.fit(docs.where(~held_out))
    found = lang_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_lines(_documents(spark, sf_dir))


def op8_shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(_documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_encode.encode(_documents(spark, sf_dir), sp_encode.load(SENTENCEPIECE_MODEL))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = token_counts.read_ranks(BYTE_RANKS)
    return token_counts.count_edited(_documents(spark, sf_dir), token_counts.sample_edits(F.col("text")), ranks)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by a hash of its id, is given a periodic tail first; a row without an id is not."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    tailed = repeat_tail(F.col("text"), lambda n: g % n, lambda n, a: 1 + F.floor((n - a) / (3 + g % 8)))
    docs = _documents(spark, sf_dir).select("doc_id", F.when(h % 10 == 0, tailed).otherwise(F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs(docs).withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_shard_records": op8_shard_records,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_ngram_join": op13_ngram_join,
}

#: Documents by sets of runs of k words, linked pairs, and the smallest id that links reach.
_LINKED = r"""
        WITH RECURSIVE read AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        cut AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < <k> THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - <k> + 2), lambda i: array_to_string(w[i:i + <k> - 1], ' '))) END AS s
            FROM read),
        each AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS m FROM cut),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM each x JOIN each y ON x.m = y.m AND x.doc_id <> y.doc_id AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80
            GROUP BY ALL HAVING count(*) * 100 >= (any_value(x.n) + any_value(y.n) - count(*)) * 80),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        joined AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(l.b, doc_id)) AS component_id FROM cut LEFT JOIN least l ON l.a = doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_filter_audit": r"""
        WITH read AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        told AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
            FROM read),
        marked AS (
            SELECT t.part, t.fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
            FROM told t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l
            ON t.doc_id = l.doc_id),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (
            SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS filter, substr(filter_order, 1, s - 1) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
        replayed AS (
            SELECT part, filter_order, step, filter, fails, good, toxic, contains(fails, filter) AS fails_here,
                   length(translate(fails, before, '')) < length(fails) AS gone
            FROM marked, steps),
        summed AS (
            SELECT part, filter_order, step, filter,
                   count(*) FILTER (WHERE NOT gone AND NOT fails_here) AS kept,
                   count(*) FILTER (WHERE NOT gone AND fails_here) AS removed,
                   count(*) FILTER (WHERE gone AND fails_here) AS redundant,
                   count(*) FILTER (WHERE fails = filter) AS unique_fails,
                   count(*) FILTER (WHERE NOT gone AND fails_here AND good) AS good_lost,
                   count(*) FILTER (WHERE NOT gone AND fails_here AND toxic) AS toxic_lost
            FROM replayed GROUP BY ALL)
        SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM summed
    """,
    "op2_near_dedup": _LINKED.replace("<k>", "2") + "SELECT *, doc_id = component_id AS kept FROM joined",
    "op13_ngram_join": _LINKED.replace("<k>", "5") + "SELECT * FROM joined",
    "op5_mix_sources": r"""
        WITH rows AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
            FROM documents),
        sizes AS (SELECT source, sum(size)::DOUBLE AS source_size FROM rows GROUP BY source),
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
                   [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM sizes),
        levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                       - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, place
                                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY 2 * source_size / weight, place
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ranked),
        targets AS (
            SELECT source, source_size::BIGINT AS source_size, place % 3 AS turn,
                   least(2 * source_size, max(level) OVER () * weight) AS target
            FROM levels),
        placed AS (
            SELECT r.doc_id, r.size, t.source_size, t.target, t.turn, floor(t.target)::BIGINT AS room,
                   (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id, r.size
                                      ROWS UNBOUNDED PRECEDING) - r.size)::BIGINT AS start
            FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
        mixed AS (
            SELECT *, greatest(0, least(size, room - start)) + greatest(0, least(size, room - source_size - start)) AS taken,
                   start / target AS share
            FROM placed)
        SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
               round(CASE WHEN taken > 0 THEN CASE turn
                   WHEN 0 THEN 1.5 - sqrt(2.25 - 2 * share)
                   WHEN 1 THEN share
                   ELSE CASE WHEN share >= 0.5 / 1.5
                        THEN 0.5 + (sqrt((1 / 1.5) * (1 / 1.5) + 2 * (4 / 1.5) * (share - 0.5 / 1.5)) - 1 / 1.5) / (4 / 1.5)
                        ELSE share / (1 / 1.5) END END END, 9) AS first_position
        FROM mixed
    """,
}
