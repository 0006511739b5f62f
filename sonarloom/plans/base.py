"""Views that many queries share, with their SQL: tables with clean categories and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared, compared_sql
from sonarloom.session import table


def finite(x: Column) -> Column:
    """NaN and infinity become null."""
    return F.when(F.abs(x) < float("inf"), x)


def category(name: str) -> Column:
    return F.nullif(F.lower(compared(F.col(name))), F.lit(""))


def category_sql(name: str) -> str:
    return f"nullif(lower({compared_sql(name)}), '')"


_CATEGORIES = ("dataset", "stem_group", "genre_sub", "split")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """source_manifest with clean categories, and seconds: out_duration where it is finite and positive."""
    x = F.col("out_duration")
    return table(spark, d, "source_manifest").withColumns({c: category(c) for c in _CATEGORIES} | {"seconds": F.when((x > 0) & (x < 86400), x)})


MANIFEST = f"""m AS (SELECT * REPLACE ({', '.join(f'{category_sql(c)} AS {c}' for c in _CATEGORIES)}),
  CASE WHEN out_duration > 0 AND out_duration < 86400 THEN out_duration END AS seconds FROM source_manifest)
"""


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The excerpt of each scanned row as blocks: series, block, db. A row is one series, by file and scan time."""
    scan = table(spark, d, "stem_duplicate_scan").filter(F.col("excerpt_levels").isNotNull())
    return (
        scan.groupBy("file_id").agg(F.max_by("excerpt_levels", F.struct("scanned_at", "excerpt_levels")).alias("levels"))
        .select(F.col("file_id").alias("series"), F.posexplode("levels").alias("block", "db"))
        .select("series", "block", finite(F.col("db").cast("double")).alias("db"))
    )


ENVELOPES = """one AS (SELECT file_id AS series, arg_max(excerpt_levels, {'a': scanned_at, 'b': excerpt_levels}) AS levels FROM stem_duplicate_scan WHERE excerpt_levels IS NOT NULL GROUP BY file_id),
env AS (SELECT series, (unnest(range(len(levels))))::INT AS block, unnest(levels)::DOUBLE AS db FROM one)
"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as short signals: vec_id, label, x (doubles)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


SIGNALS = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)\n"


def registry():
    """(QUERIES, SQL, decorator) of one module; the decorator takes the SQL that checks the query."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query
