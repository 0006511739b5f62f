"""Queries of the leak search. No SQL: mail decoding and SVD are beyond it; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.llm.leaks import leaks
from sonarloom.session import table


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each mail with each passage it holds, with the measures it was verified by."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_passages")).withColumn("cosine", F.round("cosine", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).filter(F.col("kind") == "verbatim").select("doc_id", "item_id").distinct()


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, with the number of mails that hold them word for word or in other words."""
    found = p6_leaks(spark, d).groupBy("item_id").agg(F.count_if(F.col("kind") == "verbatim").alias("n_verbatim"), F.count_if(F.col("kind") == "paraphrase").alias("n_paraphrase"))
    return table(spark, d, "eval_passages").select("item_id", "task", "held_out").join(found, "item_id")


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks, "p6_leaked_items": p6_leaked_items}
SQL: dict[str, str] = {}
