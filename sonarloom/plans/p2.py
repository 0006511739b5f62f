"""Queries of the reference check over the manifest tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared, compared_sql
from sonarloom.operators.references import dangling_references, parent_rows, reference_rows
from sonarloom.session import table


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    manifest, qc, index, taxonomy = (table(spark, d, t) for t in ("source_manifest", "audio_qc", "activity_index", "taxonomy"))
    refs = reference_rows(manifest, "source_manifest", "file_id", "ingested_at", {"out_path": "audio_qc", "instrument_canonical": "taxonomy"}).unionByName(
        reference_rows(index, "activity_index", "file_id", "scanned_at", {"file_id": "source_manifest"})
    )
    parents = (
        parent_rows(qc, "audio_qc", "path", "checked_at")
        .unionByName(parent_rows(manifest, "source_manifest", "file_id", "ingested_at"))
        .unionByName(parent_rows(taxonomy, "taxonomy", "instrument_canonical", "added_at"))
    )
    removed = table(spark, d, "removed_keys").select(compared(F.col("table_name")).alias("target"), compared(F.col("key_value")).alias("key"), "removed_at")
    return dangling_references(refs, parents, removed)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("ref_table", "ref_field", "file_id").distinct()


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, field, reason and month of the referring row."""
    return (
        _dangling(spark, d)
        .groupBy("ref_table", "ref_field", "reason", F.date_format("own_time", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n_references"))
    )


_CASES = f"""
WITH refs AS (
  SELECT 'source_manifest' ref_table, 'out_path' ref_field, 'audio_qc' target, {compared_sql('file_id')} file_id, {compared_sql('out_path')} k, ingested_at own FROM source_manifest
  UNION ALL SELECT 'source_manifest', 'instrument_canonical', 'taxonomy', {compared_sql('file_id')}, {compared_sql('instrument_canonical')}, ingested_at FROM source_manifest
  UNION ALL SELECT 'activity_index', 'file_id', 'source_manifest', {compared_sql('file_id')}, {compared_sql('file_id')}, scanned_at FROM activity_index
), parents AS (
  SELECT target, k, min(arrived) AS first_at, max(arrived) AS last_at FROM (
    SELECT 'audio_qc' target, {compared_sql('path')} k, checked_at AS arrived FROM audio_qc
    UNION ALL SELECT 'source_manifest', {compared_sql('file_id')}, ingested_at FROM source_manifest
    UNION ALL SELECT 'taxonomy', {compared_sql('instrument_canonical')}, added_at FROM taxonomy
  ) WHERE k IS NOT NULL GROUP BY 1, 2
), gone AS (
  SELECT {compared_sql('table_name')} target, {compared_sql('key_value')} k, max(removed_at) gone_at FROM removed_keys GROUP BY 1, 2
), cases AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN g.gone_at >= p.last_at THEN 'withdrawn' WHEN p.first_at > r.own THEN 'late' END reason
  FROM refs r LEFT JOIN parents p USING (target, k) LEFT JOIN gone g USING (target, k) WHERE r.k IS NOT NULL
)
"""

QUERIES = {"p2_found": p2_found, "p2_by_month": p2_by_month}
SQL = {
    "p2_found": _CASES + "SELECT DISTINCT ref_table, ref_field, file_id FROM cases WHERE reason IS NOT NULL",
    "p2_by_month": _CASES + "SELECT ref_table, ref_field, reason, strftime(own, '%Y-%m') AS month, count(*) AS n_references FROM cases WHERE reason IS NOT NULL GROUP BY ALL",
}
