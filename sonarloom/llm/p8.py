"""Queries of the consistent form. The SQL translates characters and composes; the transducer rewrites clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.llm.forms import consistent_form, form_sql, same_reading
from sonarloom.session import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return same_reading(table(spark, d, "documents"))[1].select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()


def p8_consistent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its consistent form, and whether that changed it."""
    form = consistent_form(F.col("text"))
    return table(spark, d, "documents").select("doc_id", form.alias("text"), (form != F.col("text")).alias("changed"))


QUERIES = {"p8_found": p8_found, "p8_consistent_texts": p8_consistent_texts}
SQL = {
    "p8_found": f"WITH f AS (SELECT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text IS NOT NULL) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_consistent_texts": f"SELECT doc_id, form AS text, form <> text AS changed FROM (SELECT doc_id, text, {form_sql('text')} AS form FROM documents)",
}
