"""Joins whose keys may be hot: a third of all rows under one key must not make one task.

A key is hot beyond SHARE of the rows that are counted, so at most 1 / SHARE keys are: a bound that
holds at any size, which is why the hot keys may be broadcast. Rows of a hot key are cut into parts of
about that share; the other side is repeated for each part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the rows from which a key is hot, and the rows that one task takes of a key in any case.
SHARE, LEAST = 1e-4, 50_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls being equal to one another."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of left and right, which may come from one table, with nulls equal; gives left's columns and the rest of right's."""
    equal = reduce(and_, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    return left.alias("_l").join(right.alias("_r"), equal, how).select("_l.*", *[F.col(f"_r.{c}") for c in right.columns if c not in keys])


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Of a stored table of keys and their numbers of rows, the hot ones: keys, parts. At most 1 / SHARE rows."""
    total = counts.agg(F.sum(n)).head()[0] or 0
    most = max(LEAST, SHARE * total)
    return counts.filter(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("parts"))


def in_parts(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str], part: str = "_part") -> DataFrame:
    """Adds `part`: 0, or for hot keys one of their parts, by a hash of the columns `by`."""
    marked = rows.join(F.broadcast(hot.withColumnRenamed("parts", "_parts")), keys, "left")
    return marked.withColumn(part, F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).select(*rows.columns, part)


def for_parts(rows: DataFrame, hot: DataFrame, keys: list[str], part: str = "_part") -> DataFrame:
    """Each row once for every part of its key: the side that is repeated."""
    marked = rows.join(F.broadcast(hot.withColumnRenamed("parts", "_parts")), keys, "left")
    return marked.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias(part))


def skew_join(many: DataFrame, few: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join on keys where `many` may have hot ones: its rows are spread over parts, those of `few` repeated."""
    return in_parts(many, hot, keys, by).join(for_parts(few, hot, keys), [*keys, "_part"]).drop("_part")
