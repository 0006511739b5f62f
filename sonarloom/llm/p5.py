"""Queries of the grouped splits, and SQL for the songs that straddle splits today."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared_sql
from sonarloom.llm.splits import assign_splits, manifest_rows, straddling
from sonarloom.operators.sampling import uniform_md5_sql
from sonarloom.session import cut, table


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(manifest_rows(table(spark, d, "source_manifest")), "manifest-rows")
    return rows, *assign_splits(rows, table(spark, d, "split_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return straddling(manifest_rows(table(spark, d, "source_manifest"))).select(F.col("song").alias("song_id"))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its component and new split."""
    rows, songs, _ = _assigned(spark, d)
    return rows.groupBy("file_id").agg(F.min("song").alias("song")).join(songs, "song").select("file_id", "song", "component", "new_split")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Files and share of each split against its target."""
    _, _, found = _assigned(spark, d)
    files = found.groupBy("new_split").agg(F.sum("weight").alias("files"), F.count("*").alias("components"))
    total = files.agg(F.sum("files").alias("all_files"))
    return table(spark, d, "split_targets").join(files, F.col("split") == F.col("new_split"), "left").join(F.broadcast(total)).select("split", "target_share", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("components", F.lit(0)).alias("components"), F.round(F.coalesce("files", F.lit(0)) / F.col("all_files"), 6).alias("share"))


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """Each component of songs that belong together, with its songs and files."""
    _, songs, found = _assigned(spark, d)
    return songs.groupBy("component").agg(F.count("*").alias("songs")).join(found.select("component", F.col("weight").alias("files")), "component")


_FILE = compared_sql("file_id")
#: Components by spreading the least song along the links until nothing changes: for small tables.
_COMPONENTS = f"""
WITH RECURSIVE r AS (SELECT DISTINCT {_FILE} AS file_id, lower({compared_sql('song_id')}) AS own, nullif(lower(regexp_extract({_FILE}, '^[^:]*:(.*)/[^/]*$', 1)), '') AS folder FROM source_manifest),
rows AS (SELECT DISTINCT file_id, coalesce(own, folder, lower(file_id)) AS song, folder FROM r WHERE coalesce(own, folder, file_id) IS NOT NULL),
half AS (SELECT a.song AS a, b.song AS b FROM (SELECT file_id, min(song) AS song FROM rows WHERE file_id IS NOT NULL GROUP BY file_id) a JOIN rows b USING (file_id) WHERE a.song <> b.song UNION SELECT song, folder FROM rows WHERE folder <> song),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a AS song, a AS other FROM links UNION SELECT reach.song, links.b FROM reach JOIN links ON links.a = reach.other),
songs AS (SELECT s.song, coalesce(m.component, s.song) AS component, coalesce(f.files, 0) AS files FROM (SELECT DISTINCT song FROM rows) s
  LEFT JOIN (SELECT x.song, min(x.other) AS component FROM reach x WHERE x.other IN (SELECT song FROM rows) GROUP BY x.song) m USING (song)
  LEFT JOIN (SELECT song, count(*) AS files FROM (SELECT file_id, min(song) AS song FROM rows WHERE file_id IS NOT NULL GROUP BY file_id) GROUP BY song) f USING (song)),
weights AS (SELECT component, sum(files)::BIGINT AS weight FROM songs GROUP BY component),
total AS (SELECT sum(weight) AS total FROM weights),
line AS (SELECT component, weight, total, coalesce(sum(weight) OVER (ORDER BY CASE WHEN weight > 0.001 * total THEN 1e-6 * (1 - weight / (total + 1)) ELSE 1e-6 + {uniform_md5_sql("'1'", 'component')} * (1 - 1e-6) END, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM weights CROSS JOIN total),
cuts AS (SELECT split, row_number() OVER o AS k, sum(target_share) OVER o AS upto, row_number() OVER o = count(*) OVER () AS last FROM split_targets WINDOW o AS (ORDER BY target_share DESC, split)),
placed AS (SELECT component, weight, arg_min(split, k) AS new_split FROM line JOIN cuts ON (before + weight / 2) / greatest(total, 1) < upto OR last GROUP BY ALL)
"""

QUERIES = {"p5_found": p5_found, "p5_assignment": p5_assignment, "p5_shares": p5_shares, "p5_components": p5_components}
SQL = {
    "p5_found": f"""
SELECT song_id FROM (
  SELECT coalesce(lower({compared_sql('song_id')}), nullif(lower(regexp_extract({compared_sql('file_id')}, '^[^:]*:(.*)/[^/]*$', 1)), ''), lower({compared_sql('file_id')})) AS song_id,
         nullif(lower({compared_sql('split')}), '') AS split FROM source_manifest
) WHERE split IS NOT NULL GROUP BY song_id HAVING count(DISTINCT split) > 1
""",
    "p5_assignment": _COMPONENTS + "SELECT f.file_id, f.song, s.component, p.new_split FROM (SELECT file_id, min(song) AS song FROM rows GROUP BY file_id) f JOIN songs s USING (song) JOIN placed p USING (component)",
    "p5_components": _COMPONENTS + "SELECT component, count(*) AS songs, any_value(weight) AS files FROM songs JOIN weights USING (component) GROUP BY component",
    "p5_shares": _COMPONENTS + "SELECT t.split, t.target_share, coalesce(sum(p.weight), 0)::BIGINT AS files, count(p.component) AS components, round(coalesce(sum(p.weight), 0) / any_value(total.total), 6) AS share FROM split_targets t LEFT JOIN placed p ON p.new_split = t.split CROSS JOIN total GROUP BY t.split, t.target_share",
}
