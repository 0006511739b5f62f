"""Sums of signals: members trimmed to the shortest, targets by class, one gain for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarloom.operators.skew import null_safe_join


def trimmed_sum(members: DataFrame, group: list[str], ceiling: float | None = None) -> DataFrame:
    """members: group columns and x, an array. One row per group and position: pos, v, and kept (positions of the shortest member).

    With a ceiling, all values of a group are scaled by one gain if its peak is over it. Null arrays do not
    count. Lengths are taken first, so nothing beyond the shortest is shuffled; partial sums combine map-side.
    """
    whole = members.filter(F.col("x").isNotNull())
    lengths = whole.groupBy(*group).agg(F.min(F.size("x")).alias("kept"))
    near = null_safe_join(whole, lengths, group).select(*group, "kept", F.posexplode(F.slice("x", 1, F.col("kept"))).alias("pos", "v"))
    sums = near.groupBy(*group, "pos", "kept").agg(F.sum("v").alias("v"))
    if ceiling is None:
        return sums
    peaks = sums.groupBy(*group).agg(F.max(F.abs("v")).alias("_peak"))
    gain = F.when(F.col("_peak") > ceiling, ceiling / F.col("_peak")).otherwise(1.0)
    return null_safe_join(sums, peaks, group).select(*group, "pos", "kept", (F.col("v") * gain).alias("v"))
