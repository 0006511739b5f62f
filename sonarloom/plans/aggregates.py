"""Descriptive analytics of the manifest: durations, losses, pivots, margins, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.operators.aggregate import class_loss, cumulative_below, exact_percentiles, tiered_reference, with_percentiles
from sonarloom.plans.base import ENVELOPES, MANIFEST, SIGNALS, envelopes, manifest, registry, signals
from sonarloom.session import cut, table

QUERIES, SQL, query = registry()

CUT_S = 30.0
THRESHOLDS = [3.0, 6.0, 8.0, 10.0, 30.0, 60.0, 120.0]
HELD_ASIDE = "(held aside)"
_M = f"WITH {MANIFEST} "


def _class(df: DataFrame) -> DataFrame:
    return df.withColumn("stem_class", F.coalesce("stem_group", F.lit(HELD_ASIDE)))


_CLASS = f"coalesce(stem_group, '{HELD_ASIDE}')"


@query(_M + f"""
SELECT {_CLASS} AS stem_class, count(seconds) AS files, round(sum(seconds) / 3600, 4) AS total_hours, round(quantile_cont(seconds, 0.5), 4) AS median_seconds,
  count(*) FILTER (seconds < {CUT_S}) AS files_below, round(count(*) FILTER (seconds < {CUT_S}) / count(seconds), 6) AS frac_files_below,
  round(coalesce(sum(seconds) FILTER (seconds < {CUT_S}), 0) / 3600, 4) AS hours_below, round(coalesce(sum(seconds) FILTER (seconds < {CUT_S}), 0) / sum(seconds), 6) AS frac_hours_below,
  round(coalesce(sum(seconds) FILTER (seconds >= {CUT_S}), 0) / 3600, 4) AS hours_kept
FROM m GROUP BY ALL HAVING count(seconds) > 0""")
def per_class_loss_at_segment(spark: SparkSession, d: str) -> DataFrame:
    return class_loss(_class(manifest(spark, d)), "stem_class", "seconds", CUT_S)


@query(_M + """
SELECT dataset, count(seconds) AS files, round(sum(seconds) / 3600, 4) AS total_hours, round(avg(seconds), 4) AS mean_seconds,
  round(min(seconds), 4) AS p0, round(quantile_cont(seconds, 0.05), 4) AS p5, round(quantile_cont(seconds, 0.25), 4) AS p25, round(quantile_cont(seconds, 0.5), 4) AS p50,
  round(quantile_cont(seconds, 0.75), 4) AS p75, round(quantile_cont(seconds, 0.95), 4) AS p95, round(max(seconds), 4) AS p100
FROM m WHERE dataset IS NOT NULL GROUP BY dataset""")
def pool_summary_percentiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    s, m = F.col("seconds"), manifest(spark, d).filter(F.col("dataset").isNotNull())
    sums = m.groupBy("dataset").agg(F.count(s).alias("files"), F.round(F.sum(s) / 3600, 4).alias("total_hours"), F.round(F.avg(s), 4).alias("mean_seconds"), F.round(F.min(s), 4).alias("p0"), F.round(F.max(s), 4).alias("p100"))
    return with_percentiles(m, sums, ["dataset"], s, shares).withColumns({n: F.round(n, 4) for n in shares})


_T = f"(SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)"


@query(_M + f"""
SELECT threshold, count(*) FILTER (seconds < threshold) AS files_below, round(count(*) FILTER (seconds < threshold) / count(*), 6) AS frac_files_below,
  round(coalesce(sum(seconds) FILTER (seconds < threshold), 0) / 3600, 4) AS hours_below, round(coalesce(sum(seconds) FILTER (seconds < threshold), 0) / sum(seconds), 6) AS frac_hours_below
FROM m CROSS JOIN {_T} WHERE seconds IS NOT NULL GROUP BY threshold""")
def cumulative_below_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_below(manifest(spark, d), [], "seconds", THRESHOLDS)


@query(_M + f"""
SELECT stem_class, threshold, files_below, round(files_below / files, 6) AS frac_files_below, round(seconds_below / 3600, 4) AS hours_below, round(seconds_below / total, 6) AS frac_hours_below FROM (
  SELECT {_CLASS} AS stem_class, threshold, count(*) AS files, sum(seconds) AS total, count(*) FILTER (seconds < threshold) AS files_below, coalesce(sum(seconds) FILTER (seconds < threshold), 0) AS seconds_below
  FROM m CROSS JOIN {_T} WHERE seconds IS NOT NULL GROUP BY ALL)""")
def per_class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_below(_class(manifest(spark, d)), ["stem_class"], "seconds", THRESHOLDS)


@query(_M + f"""
SELECT {_CLASS} AS stem_class, count(seconds) FILTER (dataset = '71470') AS files_71470, count(seconds) FILTER (dataset = '71955') AS files_71955,
  round(sum(seconds) FILTER (dataset = '71470') / 3600, 4) AS hours_71470, round(sum(seconds) FILTER (dataset = '71955') / 3600, 4) AS hours_71955,
  round(sum(seconds) FILTER (dataset = '71470') / sum(seconds) FILTER (dataset = '71955'), 6) AS solo_vs_ensemble FROM m GROUP BY ALL""")
def pool_size_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _class(manifest(spark, d)).groupBy("stem_class").pivot("dataset", ["71470", "71955"]).agg(F.count("seconds").alias("files"), F.sum("seconds").alias("s"))
    a, b = F.col("71470_s"), F.col("71955_s")
    return wide.select("stem_class", F.coalesce("71470_files", F.lit(0)).alias("files_71470"), F.coalesce("71955_files", F.lit(0)).alias("files_71955"), F.round(a / 3600, 4).alias("hours_71470"), F.round(b / 3600, 4).alias("hours_71955"), F.round(a / b, 6).alias("solo_vs_ensemble"))


@query("SELECT channel_action, count(*) AS n FROM source_manifest WHERE channel_action IS NOT NULL GROUP BY channel_action")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter(F.col("channel_action").isNotNull()).groupBy("channel_action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel_action")


@query(_M + """
SELECT CASE WHEN grouping(genre_sub) = 1 THEN 'All' ELSE coalesce(genre_sub, '(none)') END AS genre, CASE WHEN grouping(split) = 1 THEN 'All' ELSE coalesce(split, '(none)') END AS split, count(*) AS n
FROM m GROUP BY CUBE (genre_sub, split)""")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    def shown(c: str):
        return F.when(F.grouping(c) == 1, "All").otherwise(F.coalesce(c, F.lit("(none)")))

    return manifest(spark, d).cube("genre_sub", "split").agg(F.count("*").alias("n"), shown("genre_sub").alias("genre"), shown("split").alias("shown")).select("genre", F.col("shown").alias("split"), "n")


@query(_M + "SELECT dataset, floor(seconds / 10)::BIGINT AS bin, count(*) AS n FROM m WHERE seconds IS NOT NULL GROUP BY ALL")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter("seconds is not null").groupBy("dataset", F.floor(F.col("seconds") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""
WITH a AS (SELECT CASE WHEN isfinite(qc_active_frac) THEN qc_active_frac END x, n_blocks w FROM activity_index)
SELECT round(sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END), 6) AS weighted_active FROM a""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activity_index").select(F.when(F.abs("qc_active_frac") < float("inf"), F.col("qc_active_frac")).alias("x"), F.col("n_blocks").alias("w"))
    return a.agg(F.round(F.sum(F.col("x") * F.col("w")) / F.sum(F.when(F.col("x").isNotNull(), F.col("w"))), 6).alias("weighted_active"))


@query(_M + "SELECT dataset, round(avg(x), 4) AS macro_seconds, count(*) AS classes FROM (SELECT dataset, stem_group, avg(seconds) AS x FROM m WHERE stem_group IS NOT NULL AND seconds IS NOT NULL GROUP BY ALL) GROUP BY dataset")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    classes = manifest(spark, d).filter("stem_group is not null and seconds is not null").groupBy("dataset", "stem_group").agg(F.avg("seconds").alias("x"))
    return classes.groupBy("dataset").agg(F.round(F.avg("x"), 4).alias("macro_seconds"), F.count("*").alias("classes"))


@query("""
WITH s AS (SELECT song_id, count(DISTINCT stem_class) AS n FROM stem_duplicate_scan WHERE stem_class IS NOT NULL AND song_id IS NOT NULL GROUP BY song_id)
SELECT n AS classes, count(*) AS songs, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM s WHERE n >= 1 GROUP BY n""")
def density_distribution(spark: SparkSession, d: str) -> DataFrame:
    per_song = table(spark, d, "stem_duplicate_scan").filter("stem_class is not null and song_id is not null").groupBy("song_id").agg(F.count_distinct("stem_class").alias("classes"))
    counts = per_song.filter("classes >= 1").groupBy("classes").agg(F.count("*").alias("songs"))
    return counts.withColumn("p", F.round(F.col("songs") / F.sum("songs").over(Window.partitionBy()), 6))


@query("""
WITH a AS (SELECT stem_group, genre_sub, CASE WHEN isfinite(active_h) THEN active_h END a, CASE WHEN isfinite(total_h) THEN total_h END t, CASE WHEN isfinite(seg_p50_s) THEN seg_p50_s END p FROM activity_summary),
cells AS (SELECT stem_group, genre_sub, sum(a) AS a, sum(t) AS t, quantile_cont(p, 0.5) AS p FROM a GROUP BY ALL)
SELECT stem_group, round(sum(a), 4) AS active_h, round(sum(t), 4) AS total_h, round(sum(a) / sum(t), 6) AS active_frac, round(quantile_cont(p, 0.5), 4) AS median_of_medians FROM cells GROUP BY stem_group""")
def rollup_cell_to_class(spark: SparkSession, d: str) -> DataFrame:
    """Cells, then classes: ratio of sums, median of medians; missing cells are skipped."""
    clean = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("active_h", "total_h", "seg_p50_s")}
    cells = table(spark, d, "activity_summary").withColumns(clean).groupBy("stem_group", "genre_sub").agg(F.sum("active_h").alias("a"), F.sum("total_h").alias("t"))
    cells = cut(with_percentiles(table(spark, d, "activity_summary").withColumns(clean), cells, ["stem_group", "genre_sub"], F.col("seg_p50_s"), {"p": 0.5}), "cells")
    classes = cells.groupBy("stem_group").agg(F.round(F.sum("a"), 4).alias("active_h"), F.round(F.sum("t"), 4).alias("total_h"), F.round(F.sum("a") / F.sum("t"), 6).alias("active_frac"))
    return with_percentiles(cells, classes, ["stem_group"], F.col("p"), {"median_of_medians": 0.5}).withColumn("median_of_medians", F.round("median_of_medians", 4))


@query(_M + "SELECT dataset, role, count(*) AS n_rows, count(DISTINCT file_id) AS files, count(DISTINCT song_id) AS songs, round(sum(seconds) / 3600, 4) AS hours FROM m GROUP BY ALL")
def counts_and_hours(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("dataset", "role").agg(F.count("*").alias("n_rows"), F.count_distinct("file_id").alias("files"), F.count_distinct("song_id").alias("songs"), F.round(F.sum("seconds") / 3600, 4).alias("hours"))


@query("""
WITH q AS (SELECT dataset, role, CASE WHEN isfinite(peak) THEN peak END p, CASE WHEN isfinite(rms) THEN rms END r FROM audio_qc)
SELECT dataset, role, round(avg(p), 6) AS mean_peak, round(min(p), 6) AS min_peak, round(max(p), 6) AS max_peak, round(quantile_cont(r, 0.5), 6) AS median_rms,
  round(stddev_samp(r), 6) AS sd_rms, round(stddev_pop(r), 6) AS sdp_rms FROM q GROUP BY ALL""")
def level_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "audio_qc").withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("peak", "rms")})
    sums = q.groupBy("dataset", "role").agg(
        F.round(F.avg("peak"), 6).alias("mean_peak"), F.round(F.min("peak"), 6).alias("min_peak"), F.round(F.max("peak"), 6).alias("max_peak"),
        F.round(F.stddev_samp("rms"), 6).alias("sd_rms"), F.round(F.stddev_pop("rms"), 6).alias("sdp_rms"),
    )
    return with_percentiles(q, sums, ["dataset", "role"], F.col("rms"), {"median_rms": 0.5}).withColumn("median_rms", F.round("median_rms", 6))


@query(f"WITH {ENVELOPES} SELECT block, round(quantile_cont(db, 0.25), 4) AS p25, round(quantile_cont(db, 0.5), 4) AS p50, round(quantile_cont(db, 0.95), 4) AS p95 FROM env WHERE isfinite(db) GROUP BY block")
def list_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over a flattened list column."""
    shares = {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    return exact_percentiles(envelopes(spark, d), ["block"], F.col("db"), shares).select("block", *[F.round(n, 4).alias(n) for n in shares])


@query(_M + "SELECT dataset, round(avg(CASE WHEN out_channels = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_mono FROM m WHERE out_channels IS NOT NULL GROUP BY dataset")
def share_of_mono(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter("out_channels is not null").groupBy("dataset").agg(F.round(F.avg((F.col("out_channels") == 1).cast("double")), 6).alias("share_mono"))


@query("SELECT stem_class, min(song_id) AS first_song, array_to_string(list_sort(list(DISTINCT instrument)), ',') AS instruments FROM stem_duplicate_scan WHERE stem_class IS NOT NULL GROUP BY stem_class")
def first_and_list_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stem_duplicate_scan").filter("stem_class is not null").groupBy("stem_class").agg(F.min("song_id").alias("first_song"), F.array_join(F.sort_array(F.collect_set("instrument")), ",").alias("instruments"))


@query("""
WITH q AS (SELECT role, peak, rms FROM audio_qc WHERE isfinite(peak) AND isfinite(rms))
SELECT role, round(avg(peak), 6) AS mu_peak, round(avg(rms), 6) AS mu_rms, round(var_samp(peak), 6) AS v_peak, round(var_samp(rms), 6) AS v_rms, round(covar_samp(peak, rms), 6) AS cov FROM q GROUP BY role""")
def covariance_by_role(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "audio_qc").filter((F.abs("peak") < float("inf")) & (F.abs("rms") < float("inf")))
    return q.groupBy("role").agg(F.round(F.avg("peak"), 6).alias("mu_peak"), F.round(F.avg("rms"), 6).alias("mu_rms"), F.round(F.var_samp("peak"), 6).alias("v_peak"), F.round(F.var_samp("rms"), 6).alias("v_rms"), F.round(F.covar_samp("peak", "rms"), 6).alias("cov"))


@query(_M + """
SELECT role, round(max(x) - min(x), 4) AS spread, round(avg(abs(x)), 4) AS mean_abs FROM (SELECT role, stem_group, avg(20 * log10(rms)) AS x FROM m WHERE rms > 0 AND isfinite(rms) AND stem_group IS NOT NULL GROUP BY ALL) GROUP BY role""")
def spread_of_groups(spark: SparkSession, d: str) -> DataFrame:
    level = manifest(spark, d).filter((F.col("rms") > 0) & (F.col("rms") < float("inf")) & F.col("stem_group").isNotNull()).groupBy("role", "stem_group").agg(F.avg(20 * F.log10("rms")).alias("x"))
    return level.groupBy("role").agg(F.round(F.max("x") - F.min("x"), 4).alias("spread"), F.round(F.avg(F.abs("x")), 4).alias("mean_abs"))


_LEVELS = _M + ", l AS (SELECT dataset, stem_group, file_id, 20 * log10(rms) AS db FROM m WHERE rms > 0 AND isfinite(rms) AND stem_group IS NOT NULL)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    """RMS level in dB, which stands in for integrated loudness here."""
    return manifest(spark, d).filter((F.col("rms") > 0) & (F.col("rms") < float("inf")) & F.col("stem_group").isNotNull()).select("dataset", "stem_group", "file_id", (20 * F.log10("rms")).alias("db"))


@query(_LEVELS + """
, g AS (SELECT stem_group, count(DISTINCT file_id) AS sources, avg(db) AS m, stddev_pop(db) AS s FROM l WHERE dataset = '71955' GROUP BY stem_group), p AS (SELECT avg(db) AS m, stddev_pop(db) AS s FROM l WHERE dataset = '71955'),
c AS (SELECT DISTINCT stem_group FROM l)
SELECT c.stem_group, coalesce(g.sources, 0) AS sources, CASE WHEN g.sources >= 300 THEN 'empirical' WHEN g.sources >= 100 THEN 'class_mean' ELSE 'pooled' END AS tier,
  round(CASE WHEN g.sources >= 100 THEN g.m ELSE p.m END, 4) AS mean_db, round(CASE WHEN g.sources >= 300 THEN g.s ELSE p.s END, 4) AS spread_db
FROM c LEFT JOIN g USING (stem_group) CROSS JOIN p""")
def loudness_tier_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per class the reference it can have: its own values, its mean with the pooled spread, or the pooled ones."""
    l = levels(spark, d)
    return tiered_reference(l.filter("dataset = '71955'"), l.select("stem_group").distinct(), "stem_group", "file_id", "db", 300, 100)


@query(_LEVELS + """
, o AS (SELECT dataset, stem_group, avg(db) AS x FROM l GROUP BY ALL), p AS (SELECT avg(db) AS x FROM l)
SELECT a.dataset, b.stem_group, round(coalesce(o.x, p.x), 4) AS offset_db FROM (SELECT DISTINCT dataset FROM l) a CROSS JOIN (SELECT DISTINCT stem_group FROM l) b CROSS JOIN p LEFT JOIN o ON o.dataset = a.dataset AND o.stem_group = b.stem_group""")
def mean_offset_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Mean per dataset and class over the dense grid, the pooled mean where a cell has none."""
    l = levels(spark, d)
    cells, pooled = l.groupBy("dataset", "stem_group").agg(F.avg("db").alias("x")), l.agg(F.avg("db").alias("all"))
    # Both sides of the grid are categories: a handful of values each.
    grid = cells.select("dataset").distinct().crossJoin(cells.select("stem_group").distinct()).crossJoin(pooled)
    return grid.join(cells, ["dataset", "stem_group"], "left").select("dataset", "stem_group", F.round(F.coalesce("x", "all"), 4).alias("offset_db"))


@query(_M + "SELECT song_id, min(out_frames) AS shortest, count(*) AS members FROM m WHERE song_id IS NOT NULL AND out_frames IS NOT NULL GROUP BY song_id HAVING count(*) > 1")
def shortest_member(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter("song_id is not null and out_frames is not null").groupBy("song_id").agg(F.min("out_frames").alias("shortest"), F.count("*").alias("members")).filter("members > 1")


_STEPS = f"{SIGNALS.strip()}, l AS (SELECT vec_id, label, unnest(range(1, len(x) - 1)) AS i, x FROM s), p AS (SELECT vec_id, label, x[i] AS a, x[i + 1] AS b, x[i + 2] AS y FROM l)\n"
_GRAM = "SELECT label, sum(a * y) AS ay, sum(b * y) AS yb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM p GROUP BY label"


def _gram(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of each value with the two after it, over whole signals."""
    x = F.col("x")
    steps = F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda i: F.struct(F.element_at(x, i).alias("a"), F.element_at(x, i + 1).alias("b"), F.element_at(x, i + 2).alias("y")))

    def total(i: str, j: str):
        return F.aggregate("steps", F.lit(0.0), lambda t, r: t + r[i] * r[j])

    sums = {f"{i}{j}": total(i, j) for i, j in ("aa", "ab", "bb", "ay", "yb")}
    own = signals(spark, d).filter(F.size(x) > 2).select("label", steps.alias("steps")).select("label", *[c.alias(n) for n, c in sums.items()])
    return own.groupBy("label").agg(*[F.sum(n).alias(n) for n in sums])


@query(f"WITH {_STEPS}, g AS ({_GRAM}) SELECT label, round(ay / nullif(aa, 0), 6) AS gain, round(aa, 4) AS aa, round(ab, 4) AS ab, round(bb, 4) AS bb, round(ay, 4) AS ay, round(yb, 4) AS yb FROM g")
def gain_and_gram(spark: SparkSession, d: str) -> DataFrame:
    """Through-origin gain of a value on the one two before it, and the normal equations of the fit on both."""
    return _gram(spark, d).select("label", F.round(F.try_divide(F.col("ay"), F.nullif("aa", F.lit(0.0))), 6).alias("gain"), *[F.round(n, 4).alias(n) for n in ("aa", "ab", "bb", "ay", "yb")])


@query(f"WITH {_STEPS}, g AS ({_GRAM}), r AS (SELECT label, aa + w AS aa, ab, bb + w AS bb, ay, yb FROM (SELECT *, 0.001 * (aa + bb) / 2 AS w FROM g)) SELECT label, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 5) AS far_weight, round((yb * aa - ay * ab) / (aa * bb - ab * ab), 5) AS near_weight FROM r")
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    """Each label's signals predicted from their two last values: the ridge solution, regularised by a thousandth of the mean diagonal."""
    g = _gram(spark, d).withColumn("w", 0.001 * (F.col("aa") + F.col("bb")) / 2)
    aa, bb, ab, ay, yb = F.col("aa") + F.col("w"), F.col("bb") + F.col("w"), F.col("ab"), F.col("ay"), F.col("yb")
    return g.select("label", F.round((ay * bb - yb * ab) / (aa * bb - ab * ab), 5).alias("far_weight"), F.round((yb * aa - ay * ab) / (aa * bb - ab * ab), 5).alias("near_weight"))


@query("SELECT floor(peak / 0.05)::BIGINT AS peak_bin, floor(20 * log10(rms) / 3)::BIGINT AS level_bin, count(*) AS n FROM audio_qc WHERE isfinite(peak) AND rms > 0 AND isfinite(rms) GROUP BY ALL")
def density_bins(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional density: peaks by 0.05, levels by 3 dB."""
    q = table(spark, d, "audio_qc").filter((F.abs("peak") < float("inf")) & (F.col("rms") > 0) & (F.col("rms") < float("inf")))
    return q.groupBy(F.floor(F.col("peak") / 0.05).alias("peak_bin"), F.floor(20 * F.log10("rms") / 3).alias("level_bin")).agg(F.count("*").alias("n"))


@query(_M + f"""
SELECT CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role, count(*) AS n, count(*) FILTER (resampled) AS n_resampled FROM m GROUP BY ROLLUP (dataset, role)""")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    out = manifest(spark, d).rollup("dataset", "role").agg(F.count("*").alias("n"), F.count_if("resampled").alias("n_resampled"), F.grouping("dataset").alias("gd"), F.grouping("role").alias("gr"))
    return out.select(F.when(F.col("gd") == 1, "all").otherwise(F.col("dataset")).alias("dataset"), F.when(F.col("gr") == 1, "all").otherwise(F.col("role")).alias("role"), "n", "n_resampled")
