"""The registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as c
from .bpe import bpe_round_trip
from .decontaminate import decontaminate
from .katz import katz_scores
from .licences import licence_scan, licence_sql
from .quality import quality_scores
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_files import token_files
from .toxicity import toxicity_scores
from .transport_stream import media_round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(c.documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(c.documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(c.documents(spark, sf_dir), c.labels(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(c.documents(spark, sf_dir), c.labels(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(c.documents(spark, sf_dir))


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(c.documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(c.documents(spark, sf_dir), c.benchmark(spark, sf_dir))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(c.documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(c.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_simhash,
        op3_bpe,
        op4_quality,
        op5_toxicity,
        op6_token_files,
        op7_transport_stream,
        op8_decontaminate,
        op9_katz,
        op10_licences,
    )
}
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w) AS x),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE f < win.doc_id) AS x),
toks AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM toks ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op10_licences": licence_sql()}
