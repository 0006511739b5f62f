"""Ranks and running sums over groups of any size, without one task per group.

Rows are ordered by a hash of their key, which spreads evenly: the hash's range is cut into equal
buckets, buckets are summed, their small totals are accumulated, and only the order within one
bucket is a window. With a bucket for about BUCKET rows, no window group grows with the data.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarloom.session import cut

BUCKET = 50_000


def uniform(seed: int, *columns: Column | str) -> Column:
    """A double in [0, 1) that depends on seed and columns only, at any parallelism."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(1 << 53))


def running_sum(df: DataFrame, group: list[str], order: str, ties: list[str], weight: Column, total: str = "before", rows: int | None = None) -> DataFrame:
    """Adds `total`: the sum of weight over the group's rows before this one, by (order, ties).

    order is a column of doubles in [0, 1), as uniform() gives. rows: about how many rows the
    largest group has, counted if not given.
    """
    if rows is None:
        rows = df.groupBy(*group).count().agg(F.max("count")).head()[0] or 0 if group else df.count()
    buckets = max(1, -(-rows // BUCKET))
    df = df.withColumn("_w", weight).withColumn("_b", F.floor(F.col(order) * buckets).cast("int"))
    within = Window.partitionBy(*group, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_b").agg(F.sum("_w").alias("_s"))
    across = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_o", F.coalesce(F.sum("_s").over(across), F.lit(0))).select(*group, "_b", "_o")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_b"]]
    joined = df.withColumn("_in", F.coalesce(F.sum("_w").over(within), F.lit(0))).alias("l").join(offsets.alias("r"), reduce(and_, same))
    return joined.select("l.*", (F.col("l._in") + F.col("r._o")).alias(total)).drop("_w", "_b", "_in")


def random_rank(df: DataFrame, group: list[str], key: list[str], seed: int, rank: str = "rank", rows: int | None = None, u: Column | None = None) -> DataFrame:
    """Adds `rank`: 1, 2, ... in a random order within the group that depends on seed and key only; or in the order of u, doubles in [0, 1)."""
    ordered = df.withColumn("_u", uniform(seed, *key) if u is None else u)
    return running_sum(ordered, group, "_u", key, F.lit(1), "_before", rows).withColumn(rank, F.col("_before") + 1).drop("_u", "_before")


def ordered_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds `rank` (1, 2, ...) by order within the group, and its size as `total`, for groups of any size.

    Rows are ranged by (group, order) and written; each stretch counts its rows, the small counts are
    accumulated, and only the order within a stretch is a window. Order should end in a key.
    """
    # Written, as the bounds of a range partitioning are sampled anew each time it is run.
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
    across = Window.partitionBy(*group)
    before = counts.select(*group, "_p", F.coalesce(F.sum("_c").over(across.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_c").over(across).alias("_n"))
    within = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order)))
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_p"]])
    sizes = [F.col("r._n").alias(total)] if total else []
    return within.alias("l").join(before.alias("r"), same).select("l.*", (F.col("l._r") + F.col("r._o")).alias(rank), *sizes).drop("_p", "_r")
