"""Levels of drawn files matched to those of a reference: tiers, targets, offsets, gains.

Every draw takes its uniforms as columns, so callers decide what they hang on. Pools of any size are
ranked by buckets of a hash; a pick is an equi-join on (pool, place).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.loudness import MONO_DUPLICATION_DB
from sonarloom.operators.aggregate import tiered_reference
from sonarloom.operators.prefix import random_rank
from sonarloom.operators.sampling import MAX_GAIN_DB, MIN_GAIN_DB, MIN_SOURCE_DB, matched_gain

#: The pool of all classes together.
POOLED = "*"


def pool_pick(draws: DataFrame, pool: DataFrame, group: str, key: list[str], seed: int, u: str, keep: list[str], u_pool: Column | None = None) -> DataFrame:
    """For each draw (columns group and u, a double in [0, 1)) a member of its group, all equally likely.

    pool: group, key and `keep`. Draws whose group the pool lacks have no row. Members are ranked at random
    once, by u_pool if given; the pick is place floor(u x size).
    """
    sizes = pool.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = random_rank(pool, [group], key, seed, "_place", u=u_pool)
    placed = draws.join(sizes, group).withColumn("_place", F.floor(F.col(u) * F.col("_size")) + 1)
    return placed.join(ranked.select(group, "_place", *keep), [group, "_place"]).drop("_place", "_size")


def reference(windows: DataFrame, classes: DataFrame, empirical: int, mean: int) -> DataFrame:
    """windows: class, source, db (finite). Per class its tier by number of sources, mean and spread, as tiered_reference has them unrounded enough to draw from."""
    return tiered_reference(windows, classes, "class", "source", "db", empirical, mean)


def draw_targets(draws: DataFrame, tiers: DataFrame, windows: DataFrame, key: list[str], seed: int, jitter: float = 0.5, u_pool: Column | None = None) -> DataFrame:
    """Adds target_db to draws, which have class and the uniforms u_pick, u_jitter, u_a, u_b.

    Classes of the empirical tier take an observed value of their own windows, pooled ones one of all
    windows, each moved by up to +-jitter; the class_mean tier draws from a normal. Draws of a class without tier have no row.
    """
    known = draws.join(tiers.select("class", "tier", "mean_db", "spread_db"), "class")
    normal = F.col("mean_db") + F.col("spread_db") * F.sqrt(-2 * F.log(1 - F.col("u_a"))) * F.cos(2 * math.pi * F.col("u_b"))
    drawn = known.filter("tier = 'class_mean'").withColumn("target_db", normal)
    observed = windows.select(F.explode(F.array("class", F.lit(POOLED))).alias("pool"), *key, "db")
    asking = known.filter("tier <> 'class_mean'").withColumn("pool", F.when(F.col("tier") == "empirical", F.col("class")).otherwise(POOLED))
    picked = pool_pick(asking, observed, "pool", key, seed, "u_pick", ["db"], u_pool).withColumn("target_db", F.col("db") + (F.col("u_jitter") * 2 - 1) * jitter).drop("db", "pool")
    return picked.unionByName(drawn).drop("tier", "mean_db", "spread_db")


def window_offsets(measured: DataFrame, grid: DataFrame) -> DataFrame:
    """measured: dataset, class, off_db (a window's level less its file's). Per cell of the grid (dataset, class) the mean, else the pooled mean, else 0."""
    cells = measured.groupBy("dataset", "class").agg(F.avg("off_db").alias("own"))
    pooled = measured.agg(F.avg("off_db").alias("all"))
    return grid.join(cells, ["dataset", "class"], "left").join(F.broadcast(pooled)).select("dataset", "class", F.coalesce("own", "all", F.lit(0.0)).alias("offset_db"))


def level_as_drawn(source_db: Column, channels: Column, offset_db: Column) -> Column:
    """A file's level on the scale of drawn windows: mono counts twice, as it plays on two channels."""
    return source_db + F.when(channels == 1, MONO_DUPLICATION_DB).otherwise(0.0) + F.coalesce(offset_db, F.lit(0.0))


def stem_gain(required_db: Column, source_db: Column, matched: Column, u: Column, low: float = 0.25, high: float = 1.25) -> Column:
    """The gain of a drawn stem: to its target where its pool is matched and it can be measured, times a uniform factor for all."""
    to_target = F.when(matched, F.coalesce(matched_gain(required_db, source_db), F.lit(1.0))).otherwise(1.0)
    return to_target * (low + (high - low) * u)


def outcome(required_db: Column, source_db: Column) -> Column:
    """matched, clamped (matched at a limit) or unmeasurable, for counters."""
    measurable = (F.abs(source_db) < float("inf")) & (source_db >= MIN_SOURCE_DB)
    return F.when(~F.coalesce(measurable, F.lit(False)), "unmeasurable").when((required_db < MIN_GAIN_DB) | (required_db > MAX_GAIN_DB), "clamped").otherwise("matched")
