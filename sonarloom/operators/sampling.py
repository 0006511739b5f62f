"""Seeded draws that give the same result at any parallelism: hashes, not generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarloom.operators.prefix import random_rank
from sonarloom.operators.skew import hot_keys, skew_join
from sonarloom.session import cut


def uniform_md5(*parts: Column) -> Column:
    """A double in [0, 1) from the md5 of the parts joined by '/': other engines can give the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12), 16, 10).cast("double") / float(16**12)


def uniform_md5_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 12))::BIGINT / {float(16**12)}::DOUBLE)"


def stratified_split(df: DataFrame, stratum: str, key: str, test: float, val: float, seed: int) -> DataFrame:
    """Adds split: per stratum round(test x n) records, then round(val x n), the rest for train.

    Both at least 1 where n allows, and never the whole stratum. Strata may be of any size: ranks go by
    buckets, and a hot stratum's rows meet its size by parts. A null stratum is one of its own.
    """
    key_of = F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("-"))
    marked = df.withColumn("_g", key_of)
    sizes = cut(marked.groupBy("_g").agg(F.count("*").alias("n")), "strata")
    ranked = random_rank(marked, ["_g"], [key], seed, "_r", u=uniform_md5(F.lit(str(seed)), F.col(key)))
    n = F.col("_n")
    n_test = F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.bround(n * test)), n - 2))
    n_val = F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.bround(n * val)), n - F.col("_t") - 1))
    return (
        skew_join(ranked, sizes.withColumnRenamed("n", "_n"), hot_keys(sizes, ["_g"]), ["_g"], [key]).withColumn("_t", n_test).withColumn("_v", n_val)
        .withColumn("split", F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "val").otherwise("train"))
        .select(*[c for c in df.columns if c != "split"], "split")
    )


#: Values of a distribution that is drawn from: more is no stated distribution.
MAX_CHOICES = 10_000


def weighted_draw(draws: DataFrame, u: str, choices: DataFrame, value: str, weight: str) -> DataFrame:
    """For each draw the value in whose stretch of the cumulative weights u falls. choices: a small distribution."""
    w = Window.partitionBy().orderBy(value)
    upto = F.sum(weight).over(w) / F.sum(weight).over(Window.partitionBy())
    stretches = choices.select(value, (upto - F.col(weight) / F.sum(weight).over(Window.partitionBy())).alias("_a"), upto.alias("_b"), (F.row_number().over(w) == F.count("*").over(Window.partitionBy())).alias("_last"))
    few = F.when(F.count("*") <= MAX_CHOICES, F.array_sort(F.collect_list(F.struct("_b", "_last", value)))).otherwise(F.raise_error(F.lit(f"over {MAX_CHOICES} choices")))
    rows = F.broadcast(stretches.limit(MAX_CHOICES + 1).agg(few.alias("_s")))
    hit = F.filter("_s", lambda s: (F.col(u) < s["_b"]) | s["_last"])
    return draws.join(rows).withColumn(value, F.get(hit, F.lit(0))[value]).drop("_s")


# The clamp of a gain and the least measurable level, in dB.
MIN_GAIN_DB, MAX_GAIN_DB, MIN_SOURCE_DB = -20.0, 25.0, -70.0


def matched_gain(required_db: Column, source_db: Column, low: float = MIN_GAIN_DB, high: float = MAX_GAIN_DB, least: float = MIN_SOURCE_DB) -> Column:
    """Linear gain of a required change in dB, clamped; null where the source cannot be measured."""
    measurable = (F.abs(source_db) < float("inf")) & (source_db >= least)
    return F.when(measurable, F.pow(F.lit(10.0), F.greatest(F.lit(low), F.least(F.lit(high), required_db)) / 20))


def excerpt_start(anchor_s: Column, back: Column, window_s: float, rate: int, frames: Column) -> Column:
    """First frame of a window that holds the anchor, `back` (0 to 1) of it before; kept inside the file."""
    chunk = int(round(window_s * rate))
    wanted = F.bround((anchor_s - back * window_s) * rate).cast("long")
    return F.greatest(F.lit(0), F.least(wanted, F.greatest(F.lit(0), frames - chunk)))


def drawn_segment(segments: DataFrame, u: Column) -> DataFrame:
    """One segment of each series, drawn by length: that in whose stretch of the summed lengths u (0 to 1) falls. Series without segments give no row."""
    w = Window.partitionBy("series").orderBy("start")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = F.col("end") - F.col("start")
    point = u * F.sum(length).over(whole)
    return segments.withColumn("_upto", F.sum(length).over(w)).withColumn("_at", point).filter((F.col("_upto") - length <= F.col("_at")) & (F.col("_at") < F.col("_upto"))).drop("_upto", "_at")


# Settings that are named but do nothing yet.
RESERVED = ("coherent_mix_prob", "multi_sample", "pitch_pool_manifest", "draw_unit")


def reject_reserved(config: dict) -> None:
    """Knobs that are named but do nothing yet must not be set."""
    set_ = [k for k in RESERVED if config.get(k)]
    if set_:
        raise NotImplementedError(f"not available: {', '.join(set_)}")
