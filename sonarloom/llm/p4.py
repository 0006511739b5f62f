"""Queries of the proportional sample, and SQL for its report's exact part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared_sql
from sonarloom.llm.sampling import joint_sample, proportional_sample
from sonarloom.operators.sampling import uniform_md5_sql
from sonarloom.session import table


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Each target with what the sample drew, and whether it could be met."""
    return proportional_sample(table(spark, d, "source_manifest"), table(spark, d, "sample_targets"))[1].withColumn("drawn_share", F.round("drawn_share", 6)).withColumn("needed", F.round("needed", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).filter(~F.col("enough")).select("category_field", "category").distinct()


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn files of each category field."""
    return proportional_sample(table(spark, d, "source_manifest"), table(spark, d, "sample_targets"))[0]


def _joint(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return joint_sample(table(spark, d, "source_manifest"), table(spark, d, "sample_targets"), latest="ingested_at")


def p4_joint_sample(spark: SparkSession, d: str) -> DataFrame:
    """One sample that matches the shares of all fields at once."""
    return _joint(spark, d)[0].select("file_id", F.array_join("cell", "/").alias("cell"), "rank")


def p4_joint_report(spark: SparkSession, d: str) -> DataFrame:
    return _joint(spark, d)[1]


_FIELDS = " UNION ALL ".join(f"SELECT '{f}' AS category_field, lower({compared_sql(f)}) AS category, {compared_sql('file_id')} AS file_id FROM source_manifest" for f in ("stem_group", "dataset", "genre_sub"))

#: Each field's categories by the divisor method: floors first, then the smallest (rank - 0.5) / share, until the sample is full.
_DRAWN = f"""
WITH m AS (SELECT DISTINCT * FROM ({_FIELDS}) WHERE category IS NOT NULL AND file_id IS NOT NULL), n AS (SELECT count(DISTINCT {compared_sql('file_id')}) AS files FROM source_manifest),
have AS (SELECT category_field, category, count(*) AS available FROM m GROUP BY ALL),
t AS (SELECT s.category_field, s.category AS written, lower({compared_sql('s.category')}) AS category, s.target_share, s.min_files, coalesce(h.available, 0) AS available, greatest(s.min_files::DOUBLE, s.target_share * 0.2 * n.files) AS needed, round_even(0.2 * n.files, 0) AS size
  FROM sample_targets s CROSS JOIN n LEFT JOIN have h ON h.category_field = s.category_field AND h.category = lower({compared_sql('s.category')})),
each AS (SELECT *, unnest(range(1, available + 1)) AS r FROM t),
line AS (SELECT *, row_number() OVER (PARTITION BY category_field ORDER BY CASE WHEN r <= min_files THEN 0 ELSE 1 END, (r - 0.5) / target_share, written) AS place, sum(CASE WHEN r <= min_files THEN 1 ELSE 0 END) OVER (PARTITION BY category_field) AS floors FROM each WHERE target_share > 0 OR r <= min_files),
seats AS (SELECT category_field, written, count(*) AS drawn FROM line WHERE place <= greatest(size, floors) GROUP BY ALL),
report AS (SELECT t.*, coalesce(s.drawn, 0) AS drawn, least(t.available, ceil(t.needed))::BIGINT AS entitled FROM t LEFT JOIN seats s USING (category_field, written))
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample, "p4_joint_sample": p4_joint_sample, "p4_joint_report": p4_joint_report}
SQL = {
    "p4_found": f"""
WITH m AS ({_FIELDS}), n AS (SELECT count(DISTINCT {compared_sql('file_id')}) AS files FROM source_manifest),
have AS (SELECT category_field, category, count(DISTINCT file_id) AS available FROM m GROUP BY ALL)
SELECT DISTINCT t.category_field, t.category FROM sample_targets t CROSS JOIN n
LEFT JOIN have h ON h.category_field = t.category_field AND h.category = lower({compared_sql('t.category')})
WHERE coalesce(h.available, 0) < greatest(t.min_files::DOUBLE, t.target_share * 0.2 * n.files)
""",
    "p4_report": _DRAWN + """SELECT category_field, written AS category, target_share, min_files, available, entitled, round(needed, 6) AS needed, drawn AS seats, drawn, round(coalesce(drawn / nullif(size, 0), 0), 6) AS drawn_share,
  available >= needed AS enough, drawn >= min_files AND coalesce(drawn / nullif(size, 0), 0) >= target_share - 0.005 AS reached FROM report""",
    "p4_sample": _DRAWN + f"""SELECT category_field, category, file_id, rank, CASE WHEN rank <= min_files THEN 0 ELSE (rank - 0.5::DOUBLE) / target_share END AS priority FROM (
  SELECT report.category_field, written AS category, file_id, min_files, target_share, drawn, row_number() OVER (PARTITION BY m.category_field, written ORDER BY {uniform_md5_sql("'1'", 'm.category_field', 'm.category', 'file_id')}, file_id) AS rank
  FROM report JOIN m ON m.category_field = report.category_field AND m.category = report.category) WHERE rank <= drawn""",
}
