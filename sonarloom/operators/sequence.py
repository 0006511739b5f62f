"""Sequence operators over block series: runs, hysteresis segments, gaps, coverage.

All take long tables keyed by `series`. Every window and grouping is by series, so one shuffle
serves a whole chain; series are bounded (blocks of one file).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SegmentRules:
    """Levels in dB, lengths in blocks."""

    # The default thresholds and lengths.
    open_db: float = -60.0
    close_db: float = -70.0
    min_gap: int = 4
    min_length: int = 2
    release: int = 5

    @staticmethod
    def from_seconds(block_s: float, gap_s: float, length_s: float, release_s: float, open_db: float, close_db: float) -> SegmentRules:
        """Lengths rounded half to even; a segment lasts a block at least."""
        return SegmentRules(open_db, close_db, round(gap_s / block_s), max(1, round(length_s / block_s)), round(release_s / block_s))


def runs(blocks: DataFrame, mask: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Maximal runs of blocks where mask holds: series, start, end (half open), and aggregates in extra.

    Gaps and islands: among the blocks kept, block minus its position is constant within a run.
    """
    w = Window.partitionBy("series").orderBy("block")
    return (
        blocks.filter(mask).withColumn("_island", F.col("block") - F.row_number().over(w))
        .groupBy("series", "_island")
        .agg(F.min("block").cast("int").alias("start"), (F.max("block") + 1).cast("int").alias("end"), *[c.alias(n) for n, c in (extra or {}).items()])
        .drop("_island")
    )


def merged(intervals: DataFrame, gap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Join intervals of a series whose start lies less than `gap` blocks after all earlier ends; keep: columns constant in a series."""
    w = Window.partitionBy("series").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") - before >= gap), 1).otherwise(0)
    return (
        intervals.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w))
        .groupBy("series", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.max(c).alias(c) for c in keep]).drop("_island")
    )


def segments(blocks: DataFrame, rules: SegmentRules) -> DataFrame:
    """series, start, end of the active stretches. Empty and silent series have none.

    In this order: runs above close_db that reach open_db; gaps under min_gap bridged; stretches
    under min_length dropped; ends extended by release blocks within the series, and overlaps joined.
    Null levels are silent.
    """
    # The series' length rides along: a join with it would shuffle the blocks once more.
    whole = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = blocks.withColumn("n", (F.max("block").over(whole) + 1).cast("int"))
    opened = runs(sized, F.col("db") > rules.close_db, {"opened": F.bool_or(F.col("db") >= rules.open_db), "n": F.max("n")}).filter("opened").drop("opened")
    kept = merged(opened, rules.min_gap, ("n",)).filter(F.col("end") - F.col("start") >= rules.min_length)
    extended = kept.select("series", "start", F.least(F.col("end") + rules.release, F.col("n")).alias("end"))
    return merged(extended, 1)


def segment_table(blocks: DataFrame, rules: SegmentRules, block_s: float) -> DataFrame:
    """Segments with index, times and levels: one row each."""
    found = segments(blocks, rules).withColumn("seg_idx", (F.row_number().over(Window.partitionBy("series").orderBy("start")) - 1).cast("int"))
    inside = found.join(blocks, "series").filter((F.col("block") >= F.col("start")) & (F.col("block") < F.col("end")))
    return inside.groupBy("series", "seg_idx", "start", "end").agg(F.bround(F.avg("db"), 2).alias("mean_db"), F.bround(F.max("db"), 2).alias("peak_db")).select(
        "series", "seg_idx", F.bround(F.col("start") * block_s, 3).alias("start_s"), F.bround(F.col("end") * block_s, 3).alias("end_s"),
        F.bround((F.col("end") - F.col("start")) * block_s, 3).alias("dur_s"), "mean_db", "peak_db",
    )


def gaps(found: DataFrame) -> DataFrame:
    """Gaps between consecutive segments of a series, edges excluded: series, start, blocks."""
    following = F.lead("start").over(Window.partitionBy("series").orderBy("start"))
    return found.withColumn("_next", following).filter(F.col("_next").isNotNull()).select("series", F.col("end").alias("start"), (F.col("_next") - F.col("end")).alias("blocks"))


def undershoot(blocks: DataFrame, rules: SegmentRules) -> DataFrame:
    """Series whose segments cover less than their open blocks less the short runs: always empty."""
    return cover_balance(blocks, rules).filter(~F.col("ok")).drop("ok")


def cover_balance(blocks: DataFrame, rules: SegmentRules) -> DataFrame:
    """Of each series: raw (open blocks), allowed (blocks of short runs), covered (by segments), ok: covered is never under raw - allowed."""
    raw = blocks.groupBy("series").agg(F.count_if(F.col("db") >= rules.open_db).alias("raw"))
    short = runs(blocks, F.col("db") > rules.close_db).filter(F.col("end") - F.col("start") < rules.min_length).groupBy("series").agg(F.sum(F.col("end") - F.col("start")).alias("allowed"))
    covered = segments(blocks, rules).groupBy("series").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return raw.join(short, "series", "left").join(covered, "series", "left").fillna(0).withColumn("ok", F.col("covered") >= F.col("raw") - F.col("allowed"))


def coverage(members: DataFrame, lengths: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Share of each fixed window in which a class is active: song, window_len, window_idx, class, covered.

    members: song, class, start, end (segments of the class's members). lengths: song, n (blocks
    of the shortest member). Members of a class are united first, so nothing counts twice; the last, partial
    window is dropped; classes of a song without activity in a window have 0. Interval and
    window are matched on the windows an interval touches, an equi-join.
    """
    united = merged(members.withColumn("series", F.struct("song", "class")), 1).select("series.song", "series.class", "start", "end").join(lengths, "song")
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("window_len"), F.lit(w).alias("w")) for k, w in windows.items()]))
    whole = lengths.withColumn("_s", sizes).select("song", "_s.window_len", "_s.w", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("n") / F.col("_s.w")) - 1, F.lit(0)))).alias("window_idx"), "n").filter((F.col("window_idx") + 1) * F.col("w") <= F.col("n"))
    touched = united.withColumn("_s", sizes).withColumn("window_idx", F.explode(F.sequence(F.floor(F.col("start") / F.col("_s.w")), F.floor((F.col("end") - 1) / F.col("_s.w")))))
    w, i = F.col("_s.w"), F.col("window_idx")
    part = touched.withColumn("part", F.least("end", (i + 1) * w) - F.greatest("start", i * w)).groupBy("song", "class", F.col("_s.window_len").alias("window_len"), "window_idx").agg(F.sum("part").alias("part"))
    dense = whole.join(members.select("song", "class").distinct(), "song")
    return dense.join(part, ["song", "class", "window_len", "window_idx"], "left").select("song", "window_len", F.col("window_idx").cast("int").alias("window_idx"), "class", (F.coalesce("part", F.lit(0)) / F.col("w")).alias("covered"))


def edge_silence(blocks: DataFrame, active: Column) -> DataFrame:
    """Blocks before the first and after the last active one; an all-silent series has (length, 0)."""
    n, first, last = F.max("block") + 1, F.min(F.when(active, F.col("block"))), F.max(F.when(active, F.col("block")))
    return blocks.groupBy("series").agg(F.coalesce(first, n).cast("int").alias("lead"), F.coalesce(n - 1 - last, F.lit(0)).cast("int").alias("trail"))


def longest_run(blocks: DataFrame, mask: Column) -> DataFrame:
    """The longest run of mask per series, 0 if none."""
    found = runs(blocks, mask).groupBy("series").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    return blocks.select("series").distinct().join(found, "series", "left").select("series", F.coalesce("longest", F.lit(0)).alias("longest"))


def loudest_window(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Start of the full window with the most energy, starts being multiples of hop; 0 if none is full. Ties: the earliest.

    Window energies are differences of one running sum of squares: linear in the samples, whatever the size.
    """
    w = Window.partitionBy("series").orderBy("i")
    upto = samples.withColumn("_upto", F.sum(F.col("x") * F.col("x")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = upto.withColumn("_end", F.lead("_upto", size - 1).over(w)).withColumn("energy", F.col("_end") - F.col("_upto") + F.col("x") * F.col("x"))
    return placed.groupBy("series").agg(F.coalesce(F.max_by("i", F.when(F.col("_end").isNotNull() & (F.col("i") % hop == 0), F.struct(F.round("energy", 6), -F.col("i")))), F.lit(0)).alias("start"))
