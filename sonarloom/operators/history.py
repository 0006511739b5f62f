"""Histories of evaluations: nested metrics to rows, trajectories, the best and the last epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten(history: DataFrame, column: str = "metrics") -> DataFrame:
    """epoch -> metric -> class -> [value per song], a map column, to rows: epoch, metric, class, position, value. NaN is null."""
    epochs = history.select(F.explode(column).alias("name", "m"))
    rows = epochs.select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("epoch"), F.explode("m").alias("metric", "c")).select("epoch", "metric", F.explode("c").alias("class", "v"))
    return rows.select("epoch", "metric", "class", F.posexplode("v").alias("position", "value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def trajectory(rows: DataFrame, metric: str) -> DataFrame:
    """Per epoch the mean of class means, its change, the best so far and whether this epoch is it."""
    classes = rows.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy("epoch", "class").agg(F.avg("value").alias("m"))
    epochs = classes.groupBy("epoch").agg(F.avg("m").alias("score"))
    w = Window.partitionBy().orderBy("epoch")  # a row per epoch
    best = F.max("score").over(w)
    return epochs.select("epoch", "score", (F.col("score") - F.lag("score").over(w)).alias("delta"), best.alias("best"), (F.col("score") == best).alias("is_best"))


def trends(scores: DataFrame, order: str, score: str, last: int) -> DataFrame:
    """Adds delta, best (so far), is_best, streak (bests in a row, up to this one) and slope (per evaluation, over the last ones). A row per evaluation: few."""
    w = Window.partitionBy().orderBy(order)
    best, place = F.max(score).over(w), F.row_number().over(w)
    marked = scores.withColumn("delta", F.col(score) - F.lag(score).over(w)).withColumn("best", best).withColumn("is_best", F.col(score) == best).withColumn("_k", place)
    lost = marked.withColumn("_lost", F.sum(F.when(F.col("is_best"), 0).otherwise(1)).over(w))
    row = F.row_number().over(Window.partitionBy("_lost", "is_best").orderBy(order))
    slope = F.regr_slope(score, "_k").over(w.rowsBetween(1 - last, 0))
    return lost.withColumn("streak", F.when(F.col("is_best"), row).otherwise(0)).withColumn("slope", slope).drop("_k", "_lost")


def best_epoch(scores: DataFrame) -> DataFrame:
    """The epoch with the highest score (the earliest of ties), and the last one."""
    return scores.agg(F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best_score"), F.max("epoch").alias("last_epoch"))


def per_song(rows: DataFrame, metric: str, epoch: int, songs: DataFrame) -> DataFrame:
    """Scores of one epoch by song. songs: class, position, song_id - keyed, never zipped by order; a miss raises when run."""
    own = rows.filter((F.col("metric") == metric) & (F.col("epoch") == epoch))
    hit = F.coalesce("song_id", F.raise_error(F.lit("a score without a song")).cast("string"))
    return own.join(songs, ["class", "position"], "left").select(hit.alias("song_id"), "class", "value")
