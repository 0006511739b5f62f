"""Queries of the source mixture. SQL cannot tokenize; which sources fall short hangs on no tokenizer, so there it counts characters. Tests hold the rest against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions.text import compared_sql
from sonarloom.llm.mixing import mix
from sonarloom.session import table


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target, the share its documents reach in the mixture, and whether it falls short."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mixture holds all copies that it may, and still too few tokens."""
    full = F.col("mixed_documents") == F.col("max_repeats") * F.col("documents")
    return p7_report(spark, d).filter(full & (F.col("mixed_tokens") < F.col("target_share") * F.col("all_tokens"))).select("source").distinct()


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each document with its number of copies."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_mixture": p7_mixture}
SQL = {
    "p7_found": f"""
WITH have AS (SELECT lower({compared_sql('source')}) AS source, sum(length(text)) AS tokens FROM documents GROUP BY 1)
SELECT DISTINCT t.source FROM mix_targets t LEFT JOIN have h ON h.source = lower({compared_sql('t.source')}) WHERE t.max_repeats * coalesce(h.tokens, 0) < t.target_share * (SELECT sum(tokens) FROM have)
""",
}
