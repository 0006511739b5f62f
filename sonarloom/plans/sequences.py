"""Sequence analytics over level envelopes, with SQL that derives the same from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.operators import sequence as seq
from sonarloom.operators.aggregate import exact_percentiles
from sonarloom.operators.history import trends
from sonarloom.plans.base import ENVELOPES, envelopes, finite, registry
from sonarloom.session import cut, table

QUERIES, SQL, query = registry()

#: Excerpts have 24 blocks of about a second: levels and lengths at which all rules take effect.
RULES = seq.SegmentRules(open_db=-25.0, close_db=-30.0, min_gap=2, min_length=2, release=1)
BLOCK_S = 1.25
WINDOWS = {"six": 6, "ten": 10}

_RUNS = """runs AS (SELECT series, min(block)::INT AS a, (max(block) + 1)::INT AS b, bool_or(db >= {open}) AS opened
  FROM (SELECT *, block - row_number() OVER (PARTITION BY series ORDER BY block) AS isl FROM env WHERE db > {close} AND isfinite(db)) GROUP BY series, isl)"""
_SEGMENTS = f"""{ENVELOPES.strip()}, {_RUNS.format(open=RULES.open_db, close=RULES.close_db)},
n AS (SELECT series, max(block) + 1 AS n FROM env GROUP BY series),
b1 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY series ORDER BY a) < {RULES.min_gap} THEN 0 ELSE 1 END AS fresh FROM runs WHERE opened),
b2 AS (SELECT series, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY a) AS g FROM b1) GROUP BY series, g HAVING max(b) - min(a) >= {RULES.min_length}),
b3 AS (SELECT series, a, least(b + {RULES.release}, n) AS b FROM b2 JOIN n USING (series)),
b4 AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY series ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM b3),
seg AS (SELECT series, min(a)::INT AS a, max(b)::INT AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY a) AS g FROM b4) GROUP BY series, g)
"""


@query(f"WITH {ENVELOPES.strip()}, {_RUNS.format(open=-1000, close=-30.0)} SELECT series, a AS start, b AS \"end\" FROM runs")
def runs_of_true(spark: SparkSession, d: str) -> DataFrame:
    return seq.runs(envelopes(spark, d), F.col("db") > -30.0)


@query(f'WITH {_SEGMENTS} SELECT series, a AS start, b AS "end" FROM seg')
def hysteresis_segments(spark: SparkSession, d: str) -> DataFrame:
    return seq.segments(envelopes(spark, d), RULES)


@query(f"""WITH {_SEGMENTS} SELECT seg.series, (row_number() OVER (PARTITION BY seg.series ORDER BY a) - 1)::INT AS seg_idx, round_even(a * {BLOCK_S}::DOUBLE, 3) AS start_s, round_even(b * {BLOCK_S}::DOUBLE, 3) AS end_s,
  round_even((b - a) * {BLOCK_S}::DOUBLE, 3) AS dur_s, round(avg(db), 1) AS mean_db, round_even(max(db), 2) AS peak_db FROM seg JOIN env ON env.series = seg.series AND block >= a AND block < b GROUP BY seg.series, a, b""")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Segment rows; the mean is shown to one decimal so that the order of a sum cannot show."""
    return seq.segment_table(envelopes(spark, d), RULES, BLOCK_S).withColumn("mean_db", F.round("mean_db", 1))


SQL["segment_stats"] = SQL["segment_stats"].replace("round(avg(db), 1)", "round(round_even(avg(db), 2), 1)")


@query(f'WITH {_SEGMENTS} SELECT series, b AS start, nx - b AS blocks FROM (SELECT *, lead(a) OVER (PARTITION BY series ORDER BY a) AS nx FROM seg) WHERE nx IS NOT NULL')
def internal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return seq.gaps(seq.segments(envelopes(spark, d), RULES))


_CLASS_OF = "cls AS (SELECT file_id AS series, max(stem_class) AS class, max(song_id) AS song FROM stem_duplicate_scan GROUP BY file_id)"


def classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stem_duplicate_scan").groupBy(F.col("file_id").alias("series")).agg(F.max("stem_class").alias("class"), F.max("song_id").alias("song"))


@query(f"""WITH {_SEGMENTS}, {_CLASS_OF},
g AS (SELECT series, nx - b AS gap FROM (SELECT *, lead(a) OVER (PARTITION BY series ORDER BY a) AS nx FROM seg) WHERE nx IS NOT NULL),
s AS (SELECT class, count(*) AS segments, quantile_cont(b - a, 0.25) AS p25, quantile_cont(b - a, 0.5) AS p50, quantile_cont(b - a, 0.75) AS p75 FROM seg JOIN cls USING (series) WHERE class IS NOT NULL GROUP BY class),
q AS (SELECT class, quantile_cont(gap, 0.5) AS gap_p50, quantile_cont(gap, 0.95) AS gap_p95 FROM g JOIN cls USING (series) WHERE class IS NOT NULL GROUP BY class)
SELECT class, segments, round(p25, 4) AS seg_p25, round(p50, 4) AS seg_p50, round(p75, 4) AS seg_p75, round(gap_p50, 4) AS gap_p50, round(gap_p95, 4) AS gap_p95 FROM s LEFT JOIN q USING (class)""")
def gap_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per class percentiles of segment and gap lengths; without gaps they are null."""
    found = cut(seq.segments(envelopes(spark, d), RULES), "segments")
    cls = cut(classes(spark, d).filter("class is not null"), "classes")
    lengths = found.join(cls, "series").select("class", (F.col("end") - F.col("start")).alias("len"))
    gaps = seq.gaps(found).join(cls, "series")
    counted = exact_percentiles(lengths, ["class"], F.col("len"), {"seg_p25": 0.25, "seg_p50": 0.5, "seg_p75": 0.75}, "segments")
    silent = exact_percentiles(gaps, ["class"], F.col("blocks"), {"gap_p50": 0.5, "gap_p95": 0.95}).drop("_n")
    shown = ("seg_p25", "seg_p50", "seg_p75", "gap_p50", "gap_p95")
    return counted.join(silent, "class", "left").select("class", "segments", *[F.round(n, 4).alias(n) for n in shown])


_COVERAGE = f"""{_SEGMENTS}, {_CLASS_OF},
members AS (SELECT song, class, a, b FROM seg JOIN cls USING (series) WHERE song IS NOT NULL AND class IS NOT NULL),
len AS (SELECT song, min(n) AS n FROM n JOIN cls USING (series) WHERE song IS NOT NULL GROUP BY song),
wins AS (SELECT song, name AS window_len, w, unnest(range((n // w)::BIGINT)) AS i FROM len CROSS JOIN (VALUES ('six', 6), ('ten', 10)) v(name, w)),
act AS (SELECT DISTINCT song, class, unnest(range(a, b)) AS block FROM members),
cov AS (SELECT wins.song, window_len, i::INT AS window_idx, c.class, count(act.block) / w::DOUBLE AS covered FROM wins JOIN (SELECT DISTINCT song, class FROM members) c USING (song)
  LEFT JOIN act ON act.song = wins.song AND act.class = c.class AND act.block >= i * w AND act.block < (i + 1) * w GROUP BY ALL)
"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    # One scan: a file's levels, class, song and length come together and are written once.
    scan, levels = table(spark, d, "stem_duplicate_scan"), F.col("excerpt_levels")
    files = cut(scan.groupBy(F.col("file_id").alias("series")).agg(F.max_by(levels, F.when(levels.isNotNull(), F.struct("scanned_at", levels))).alias("levels"), F.max("stem_class").alias("class"), F.max("song_id").alias("song")).filter("levels is not null and song is not null"), "files")
    env = files.filter("class is not null").select("series", F.posexplode("levels").alias("block", "x")).select("series", "block", finite(F.col("x").cast("double")).alias("db"))
    # Read twice below, and small beside the blocks: written once.
    members = cut(seq.segments(env, RULES).join(files.select("series", "song", "class"), "series").select("song", "class", "start", "end"), "members")
    lengths = files.filter(F.size("levels") > 0).groupBy("song").agg(F.min(F.size("levels")).alias("n"))
    return seq.coverage(members, lengths, WINDOWS)


@query(f"WITH {_COVERAGE} SELECT song, window_len, window_idx, class, round(covered, 6) AS covered FROM (SELECT song, window_len, window_idx, class, any_value(covered) AS covered FROM cov GROUP BY ALL)")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).withColumn("covered", F.round("covered", 6))


SQL["window_coverage"] = f"WITH {_COVERAGE.replace('count(act.block) / w::DOUBLE AS covered', 'w, count(act.block) AS c')} SELECT song, window_len, window_idx, class, round(c / w::DOUBLE, 6) AS covered FROM cov"


@query("WITH " + _COVERAGE.replace("count(act.block) / w::DOUBLE AS covered", "w, count(act.block) AS c") + """
SELECT window_len, audible, count(*) AS windows FROM (SELECT song, window_len, window_idx, count(*) FILTER (c / w::DOUBLE > 0.25) AS audible FROM cov GROUP BY song, window_len, window_idx) GROUP BY ALL""")
def audible_class_count(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the number of classes active in more than a quarter of them."""
    per = _coverage(spark, d).groupBy("song", "window_len", "window_idx").agg(F.count_if(F.col("covered") > 0.25).alias("audible"))
    return per.groupBy("window_len", "audible").agg(F.count("*").alias("windows"))


@query(f"""WITH {ENVELOPES} SELECT series, coalesce(min(block) FILTER (db >= -25 AND isfinite(db)), max(block) + 1)::INT AS lead, coalesce(max(block) - max(block) FILTER (db >= -25 AND isfinite(db)), 0)::INT AS trail FROM env GROUP BY series""")
def edge_silence(spark: SparkSession, d: str) -> DataFrame:
    return seq.edge_silence(envelopes(spark, d), F.col("db") >= -25)


@query(f"WITH {ENVELOPES.strip()}, {_RUNS.format(open=-1000, close=-26.0)} SELECT series, coalesce(max(b - a), 0)::INT AS longest FROM (SELECT DISTINCT series FROM env) LEFT JOIN runs USING (series) GROUP BY series")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return seq.longest_run(envelopes(spark, d), F.col("db") > -26.0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_q FROM lineitem")
def running_offset(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive running sums: where each member starts in its concatenation."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("offset_q"))


@query(f"""WITH {_SEGMENTS}, raw AS (SELECT series, count(*) FILTER (db >= {RULES.open_db} AND isfinite(db)) AS raw FROM env GROUP BY series),
short AS (SELECT series, sum(b - a)::BIGINT AS allowed FROM runs WHERE b - a < {RULES.min_length} GROUP BY series), c AS (SELECT series, sum(b - a)::BIGINT AS covered FROM seg GROUP BY series)
SELECT series, raw, coalesce(allowed, 0) AS allowed, coalesce(covered, 0) AS covered, true AS ok FROM raw LEFT JOIN short USING (series) LEFT JOIN c USING (series)""")
def segment_invariant(spark: SparkSession, d: str) -> DataFrame:
    """What each series has open, what short runs may cost, and what its segments cover: never less than the first less the second."""
    return seq.cover_balance(envelopes(spark, d), RULES)


@query("""
WITH m AS (SELECT scan_date::VARCHAR AS epoch, avg(seg_p50_s) AS score FROM activity_summary WHERE isfinite(seg_p50_s) GROUP BY 1),
d AS (SELECT *, row_number() OVER o AS k, score - lag(score) OVER o AS delta, max(score) OVER o AS best FROM m WINDOW o AS (ORDER BY epoch)),
s AS (SELECT *, sum(CASE WHEN score = best THEN 0 ELSE 1 END) OVER (ORDER BY epoch) AS lost FROM d)
SELECT epoch, round(score, 4) AS score, round(delta, 4) AS delta, round(best, 4) AS best, score = best AS is_best, (CASE WHEN score = best THEN row_number() OVER (PARTITION BY lost, score = best ORDER BY epoch) ELSE 0 END)::INT AS streak,
  round(regr_slope(score, k) OVER (ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS slope FROM s""")
def evaluation_deltas(spark: SparkSession, d: str) -> DataFrame:
    """From one day's mean to the next: change, the best so far, how many bests in a row, and the slope over the last five."""
    days = table(spark, d, "activity_summary").filter(F.abs("seg_p50_s") < float("inf")).groupBy(F.col("scan_date").cast("string").alias("epoch")).agg(F.avg("seg_p50_s").alias("score"))
    out = trends(days, "epoch", "score", 5)
    return out.select("epoch", *[F.round(c, 4).alias(c) for c in ("score", "delta", "best")], "is_best", "streak", F.round("slope", 4).alias("slope"))
