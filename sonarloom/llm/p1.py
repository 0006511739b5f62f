"""Queries of the cross-split overlaps, and their SQL: every pair of the two sides, compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared_sql
from sonarloom.llm.overlaps import LEVELS, NEED, TOLERANCE, cross_split_overlaps
from sonarloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlaps(table(spark, d, "stem_duplicate_scan")).select("file_id_a", "file_id_b").distinct()


def p1_by_split_and_genre(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed pairs per split and genre of the evaluation file."""
    pairs = cross_split_overlaps(table(spark, d, "stem_duplicate_scan"))
    return pairs.groupBy("split", "genre").agg(F.count("*").alias("n_pairs"), F.count_distinct("eval_file").alias("n_eval_files"))


_ROWS = f"""
WITH r AS (
  SELECT DISTINCT {compared_sql('file_id')} f, lower({compared_sql('split')}) s, {compared_sql('genre_sub')} genre, nullif(lower({compared_sql('excerpt_md5')}), '') m,
         CASE WHEN len(excerpt_levels) = {LEVELS} THEN list_transform(excerpt_levels, lambda x: x::DOUBLE) END l
  FROM stem_duplicate_scan WHERE carries_signal
), both_sides AS (
  SELECT e.f ef, t.f tf, e.s AS split, e.genre AS genre, e.m = t.m AS same, list_sort(list_transform(range(1, {LEVELS + 1}), lambda k: e.l[k] - t.l[k])) AS off
  FROM r e JOIN r t ON e.s IN ('val', 'test') AND t.s = 'train' AND e.f <> t.f
), pairs AS (
  SELECT ef, tf, split, genre FROM both_sides
  WHERE same OR list_bool_or(list_transform(range(1, {LEVELS - NEED + 2}), lambda i: off[i + {NEED - 1}] - off[i] <= {2 * TOLERANCE}))
)
"""

QUERIES = {"p1_found": p1_found, "p1_by_split_and_genre": p1_by_split_and_genre}
SQL = {
    "p1_found": _ROWS + "SELECT DISTINCT least(ef, tf) AS file_id_a, greatest(ef, tf) AS file_id_b FROM pairs",
    "p1_by_split_and_genre": _ROWS + "SELECT split, genre, count(*) AS n_pairs, count(DISTINCT ef) AS n_eval_files FROM (SELECT DISTINCT * FROM pairs) GROUP BY ALL",
}
