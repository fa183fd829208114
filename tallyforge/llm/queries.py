"""The driver's queries for the problems 2, 6, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import Stash, spread, table
from . import mix, residue, sketches, terms, tokenizer


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marks(table(spark, folder, "med_events"), table(spark, folder, "summary"))


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marked_terms(table(spark, folder, "med_events"))


def p6_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.breakdowns(table(spark, folder, "med_events"), table(spark, folder, "subject_splits"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(spread(table(spark, folder, "documents").select("doc_id", "text")))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    stash = Stash(spark)
    documents = spread(table(spark, folder, "documents").filter("source is not null").select("doc_id", "source", "text"))
    sized, _ = stash.put(tokenizer.token_counts(documents, ["doc_id", "source"]))
    return mix.mix(sized, table(spark, folder, "mix_targets"), stash)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(spread(table(spark, folder, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p6_distinct, p8_ids, p9_mix, p9_shares, p10_found)}

_REAL = """
WITH whole AS (
  SELECT code, count(*) AS n, count(DISTINCT subject_id) AS m FROM med_events WHERE code IS NOT NULL GROUP BY code
), shard AS (
  SELECT shard, code, count(*) AS n, count(DISTINCT subject_id) AS m FROM med_events WHERE code IS NOT NULL GROUP BY shard, code
), total AS (SELECT count(DISTINCT subject_id) AS n FROM med_events), judged AS (
  SELECT s.code, s.event_count, s.subject_count, s.is_masked, coalesce(r.n, 0) AS n, coalesce(r.m, 0) AS m
  FROM summary s LEFT JOIN shard r ON r.code = s.code AND r.shard IS NOT DISTINCT FROM s.shard
  WHERE s.code <> '__RARE__'
)
"""

ORACLE = {
    "p2_found": _REAL
    + """
SELECT code, 'rare' AS mark FROM whole WHERE m < 20
UNION ALL SELECT code, 'common' FROM whole WHERE m * 5 >= (SELECT n FROM total)
UNION ALL SELECT DISTINCT code, 'wrong' FROM judged
  WHERE event_count IS NULL OR subject_count IS NULL OR event_count <> n OR subject_count <> m
UNION ALL SELECT DISTINCT code, 'leaked' FROM judged WHERE NOT coalesce(is_masked, false) AND m < 5""",
    "p2_terms": _REAL
    + """
SELECT code, n AS n_events, m AS n_subjects, m < 20 AS is_rare, m * 5 >= (SELECT n FROM total) AS is_common FROM whole""",
}
