"""Sessions and segments on an event stream: new capability beside the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarloom.operators.sequence import SegmentRules, segments


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream (or table): key, start, end, n. On a stream, events later than `late` are dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def segment_batches(rules: SegmentRules, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: segments each micro-batch of whole series (series, block, db) and hands them to sink."""

    def run(batch: DataFrame, number: int) -> None:
        sink(segments(batch, rules), number)

    return run
