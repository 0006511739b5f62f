"""Checks on distributions: two-sample Kolmogorov-Smirnov, 2-D Gaussians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarloom.session import cut


def ks_two_sample(values: DataFrame) -> DataFrame:
    """values: first (boolean), x. One row: statistic, p_value (asymptotic), n_a, n_b. Null x is ignored.

    Equal values are counted first; the cumulative counts then run over ranges of x, whose small totals
    are accumulated, so that no task sorts the whole. An empty side gives nulls.
    """
    counts = values.filter(F.col("x").isNotNull()).groupBy("x").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b"))
    # One sort by ranges of x: each partition is a stretch, numbered in order of x.
    # Written, as the bounds of a range partitioning are sampled anew each time it is run.
    stretches = cut(counts.repartitionByRange("x").withColumn("_p", F.spark_partition_id()), "stretches")
    sums = stretches.groupBy("_p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sums.select("_p", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("ob"))
    total = sums.agg(F.sum("sa").alias("n_a"), F.sum("sb").alias("n_b"))
    within = Window.partitionBy("_p").orderBy("x")
    gap = F.abs((F.col("oa") + F.col("ca")) / F.col("n_a") - (F.col("ob") + F.col("cb")) / F.col("n_b"))
    found = (
        stretches.withColumn("ca", F.sum("a").over(within)).withColumn("cb", F.sum("b").over(within))
        .join(F.broadcast(offsets), "_p").join(F.broadcast(total)).groupBy("n_a", "n_b").agg(F.max(gap).alias("statistic"))
    )
    return found.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_a"), F.col("n_b"))).select("statistic", "p_value", "n_a", "n_b")


def ks_p_value(statistic: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value."""
    root = F.sqrt(n_a * n_b / (n_a + n_b))
    z = (root + 0.12 + 0.11 / root) * statistic
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z))
    return F.when(z < 1e-3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _moments(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    return df.agg(*[c.alias(f"{name}_{n}") for n, c in {"mx": F.avg(x), "my": F.avg(y), "vx": F.var_samp(x), "vy": F.var_samp(y), "c": F.covar_samp(x, y)}.items()])


def _mahalanobis(name: str, x: str, y: str) -> tuple[Column, Column]:
    """(squared distance, determinant) with the closed inverse of a 2 x 2 covariance."""
    m = {k: F.col(f"{name}_{k}") for k in ("mx", "my", "vx", "vy", "c")}
    dx, dy, det = F.col(x) - m["mx"], F.col(y) - m["my"], m["vx"] * m["vy"] - m["c"] * m["c"]
    return (dx * dx * m["vy"] - 2 * dx * dy * m["c"] + dy * dy * m["vx"]) / det, det


def gaussian_log_odds(df: DataFrame, first: DataFrame, second: DataFrame, x: str, y: str, prior: float = 0.5) -> DataFrame:
    """Adds log_odds (first against second population, 2-D Gaussians) and distance (squared, to the first).

    The moments are one row each, so they are broadcast. Populations of under two rows give nulls.
    """
    scored = df.join(F.broadcast(_moments(first, x, y, "_a"))).join(F.broadcast(_moments(second, x, y, "_b")))
    (da, deta), (db, detb) = _mahalanobis("_a", x, y), _mahalanobis("_b", x, y)
    odds = -0.5 * F.log(deta) - 0.5 * da + 0.5 * F.log(detb) + 0.5 * db + F.log(F.lit(prior / (1 - prior)))
    return scored.withColumn("log_odds", odds).withColumn("distance", da).select(*df.columns, "log_odds", "distance")
