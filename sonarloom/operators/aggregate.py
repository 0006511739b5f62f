"""Aggregates over groups of files: losses at a cut point, cumulative shares, tiered references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarloom.operators.skew import same
from sonarloom.session import cut


def exact_percentiles(df: DataFrame, group: list[str], value: Column, shares: dict[str, float], count: str = "_n") -> DataFrame:
    """Per group exact percentiles with linear interpolation, as columns named by shares, and the number of values.

    For groups of any size: equal values are counted first, then ranged by (group, value); every stretch
    sums its counts, the small sums are accumulated, and each share takes its two neighbours by rank. No
    task sees a whole group, and none holds its values. Nulls are no values; groups without any have no row.
    """
    cells = df.select(*group, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    # Written, as the bounds of a range partitioning are sampled anew each time it is run.
    ranged = cut(cells.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()), "ranged-values")
    sums = ranged.groupBy(*group, "_p").agg(F.sum("_c").alias("_s"))
    across = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_s").over(across.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*group, "_p", before.alias("_o"), F.sum("_s").over(across).alias(count))
    within = ranged.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group, "_p").orderBy("_v")))
    placed = within.join(offsets, same(within, offsets, [*group, "_p"])).select(*[within[g] for g in group], "_v", (F.col("_o") + F.col("_upto")).alias("_last"), (F.col("_o") + F.col("_upto") - F.col("_c")).alias("_first"), count)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_v")))

    sides = [c for name, share in shares.items() for c in (at(F.floor((F.col(count) - 1) * share)).alias(f"_lo_{name}"), at(F.ceil((F.col(count) - 1) * share)).alias(f"_hi_{name}"))]
    found = placed.groupBy(*group, count).agg(*sides)

    def between(name: str, share: float) -> Column:
        place = (F.col(count) - 1) * share
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col(f"_lo_{name}")).otherwise((high - place) * F.col(f"_lo_{name}") + (place - low) * F.col(f"_hi_{name}"))

    return found.select(*group, count, *[between(n, p).alias(n) for n, p in shares.items()])


def with_percentiles(df: DataFrame, aggregated: DataFrame, group: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Adds exact percentiles of df's value to a table with one row per group."""
    found = exact_percentiles(df, group, value, shares)
    joined = aggregated.join(found, same(aggregated, found, group), "left") if group else aggregated.join(F.broadcast(found))
    return joined.select(*[aggregated[c] for c in aggregated.columns], *shares)


def class_loss(df: DataFrame, group: str, value: str, limit: float) -> DataFrame:
    """Per group: what a minimum of `limit` would cost. Equal to it is kept; null values do not count."""
    v, below = F.col(value), F.col(value) < limit
    lost = F.coalesce(F.sum(F.when(below, v)), F.lit(0.0))
    sums = (
        df.groupBy(group)
        .agg(
            F.count(v).alias("files"), F.round(F.sum(v) / 3600, 4).alias("total_hours"),
            F.count_if(below).alias("files_below"), F.round(F.try_divide(F.count_if(below), F.count(v)), 6).alias("frac_files_below"),
            F.round(lost / 3600, 4).alias("hours_below"), F.round(F.try_divide(lost, F.sum(v)), 6).alias("frac_hours_below"),
            F.round(F.coalesce(F.sum(F.when(v >= limit, v)), F.lit(0.0)) / 3600, 4).alias("hours_kept"),
        )
        .filter(F.col("files") > 0)
    )
    return with_percentiles(df, sums, [group], v, {"median_seconds": 0.5}).withColumn("median_seconds", F.round("median_seconds", 4)).orderBy(F.desc("frac_hours_below"), group)


def cumulative_below(df: DataFrame, group: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Per group and threshold: files and hours strictly below, with their shares. One pass, no join."""
    v = F.col(value)
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(v < t).alias("n"), F.coalesce(F.sum(F.when(v < t, v)), F.lit(0.0)).alias("s")) for t in thresholds]
    sums = df.filter(v.isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"), F.sum(v).alias("_s"), F.array(*each).alias("_t"))
    return sums.select(*group, "_n", "_s", F.inline("_t")).filter(F.col("_n") > 0).select(
        *group, "threshold", F.col("n").alias("files_below"), F.round(F.try_divide(F.col("n"), F.col("_n")), 6).alias("frac_files_below"),
        F.round(F.col("s") / 3600, 4).alias("hours_below"), F.round(F.try_divide(F.col("s"), F.col("_s")), 6).alias("frac_hours_below"),
    )


def tiered_reference(values: DataFrame, classes: DataFrame, group: str, source: str, value: str, empirical: int, mean: int) -> DataFrame:
    """Per class a tier by its number of distinct sources, with the mean and population spread that the tier uses."""
    own = values.groupBy(group).agg(F.count_distinct(source).alias("sources"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    pooled = values.agg(F.avg(value).alias("pm"), F.stddev_pop(value).alias("ps"))
    n = F.col("sources")
    return classes.join(own, group, "left").join(F.broadcast(pooled)).select(
        group, F.coalesce(n, F.lit(0)).alias("sources"), F.when(n >= empirical, "empirical").when(n >= mean, "class_mean").otherwise("pooled").alias("tier"),
        F.round(F.when(n >= mean, F.col("m")).otherwise(F.col("pm")), 4).alias("mean_db"), F.round(F.when(n >= empirical, F.col("s")).otherwise(F.col("ps")), 4).alias("spread_db"),
    )
