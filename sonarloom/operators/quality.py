"""Invariants as tables of offenders: an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Violated(ValueError):
    pass


def not_unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of left that right lacks; null keys are no references."""
    return left.select(*on).dropna().distinct().join(right.select(*on).distinct(), on, "left_anti")


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1 if len(columns) > 1 else F.col(columns[0]).isNull())


def not_constant(df: DataFrame, column: str) -> DataFrame:
    """One row with the values, if there are several."""
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most")).filter("least <> most")


def drifted(df: DataFrame, measured: str, expected: str, low: float, high: float) -> DataFrame:
    """Rows whose relative deviation is outside (low, high]."""
    off = F.try_divide(F.col(measured) - F.col(expected), F.col(expected))
    return df.withColumn("drift", off).filter(~((off > low) & (off <= high)))


def demand_none(offenders: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with the first few offenders, if there are any."""
    rows = offenders.limit(shown).collect()
    if rows:
        raise Violated(f"{what}: {[r.asDict() for r in rows]}")
