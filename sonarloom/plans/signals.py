"""Signal measures over short arrays, and distribution checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.functions import signal as sig
from sonarloom.operators.distribution import gaussian_log_odds, ks_two_sample as ks
from sonarloom.operators.prefix import ordered_rank
from sonarloom.operators.sequence import loudest_window as loudest
from sonarloom.operators.mixture import trimmed_sum
from sonarloom.plans.base import SIGNALS, registry, signals
from sonarloom.session import table

QUERIES, SQL, query = registry()
_S = f"WITH {SIGNALS} "
_RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"
_PEAK = "list_max(list_transform(x, lambda v: abs(v)))"


@query(_S + f"SELECT vec_id, round({_PEAK}, 6) AS peak, round({_RMS}, 6) AS rms, round(list_avg(x), 6) AS dc, round(len(list_filter(x, lambda v: abs(v) >= 0.2)) / len(x), 6) AS clip_frac, len(list_distinct(x)) > 1 AS varies FROM s")
def signal_qc(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return signals(spark, d).select("vec_id", F.round(sig.peak(x), 6).alias("peak"), F.round(sig.rms(x), 6).alias("rms"), F.round(sig.mean(x), 6).alias("dc"), F.round(sig.share_over(x, 0.2), 6).alias("clip_frac"), (F.size(F.array_distinct(x)) > 1).alias("varies"))


_ALIGNED = "list_transform(range(1, len(x) + 1), lambda i: {0})"


@query(f"""WITH {SIGNALS.strip()}, p AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_max({_ALIGNED.format('abs(x[i] - y[i])')}), 6) AS lr_max_diff, x = y AS lr_identical, list_bool_and({_ALIGNED.format('abs(x[i] - y[i]) <= 0.05 + 0.1 * abs(y[i])')}) AS lr_close,
  round(list_sum({_ALIGNED.format('(x[i] - list_avg(x)) * (y[i] - list_avg(y))')}) / sqrt(list_sum({_ALIGNED.format('(x[i] - list_avg(x)) ^ 2')}) * list_sum({_ALIGNED.format('(y[i] - list_avg(y)) ^ 2')})), 5) AS lr_corr FROM p""")
def stereo_qc(spark: SparkSession, d: str) -> DataFrame:
    """What the two channels of a signal have in common; neighbours stand for left and right."""
    x, y = F.col("x"), F.col("y")
    return _paired(spark, d).select("vec_id", F.round(sig.peak(F.zip_with(x, y, lambda a, b: a - b)), 6).alias("lr_max_diff"), (x == y).alias("lr_identical"), sig.close_to(x, y, 0.05, 0.1).alias("lr_close"), F.round(sig.correlation(x, y), 5).alias("lr_corr"))


@query(_S + f"""SELECT vec_id, round({_PEAK.replace('x,', '(list_filter(x, lambda v, i: (i - 1) % 4 = 0)),')}, 6) AS decimated_peak, round(list_sum(x[(len(x) - 10) // 2 + 1 : (len(x) - 10) // 2 + 10]), 5) AS centre_sum, round(x[len(x)], 6) AS swapped_first, 2::INT AS channels FROM s""")
def array_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth value, ten around the middle, a mono signal on two channels, and channels swapped."""
    x = F.col("x")
    stereo = sig.to_stereo(sig.picked_channel(F.array(x, F.reverse(x)), 0))
    return signals(spark, d).select("vec_id", F.round(sig.peak(sig.decimated(x, 4)), 6).alias("decimated_peak"), F.round(sig.mean(sig.centred(x, 10)) * 10, 5).alias("centre_sum"), F.round(F.get(F.get(sig.swapped(F.array(x, F.reverse(x))), F.lit(0)), F.lit(0)), 6).alias("swapped_first"), F.size(stereo).alias("channels"))


@query(_S + f"""SELECT vec_id, (u.b)::INT AS block, round(20 * log10(greatest(1e-12, sqrt(list_sum(list_transform(range(b * 8 + 1, b * 8 + 9), lambda i: ((x[i] + x[len(x) + 1 - i]) / 2) ^ 2)) / 8))), 4) AS db FROM s, unnest(range(len(x) // 8)) u(b)""")
def mono_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Levels of tenths of a second of two channels' mean, at 80 values a second; a signal and its reverse are the channels."""
    channels = F.array(F.col("x"), F.reverse("x"))
    return signals(spark, d).select("vec_id", F.posexplode(sig.mono_envelope_db(channels, 80)).alias("block", "db")).select("vec_id", "block", F.round("db", 4).alias("db"))


@query(_S + f"SELECT vec_id, round(20 * log10({_PEAK} / {_RMS}), 4) AS crest, round(greatest(-120, 20 * log10({_RMS})), 4) AS level FROM s WHERE {_PEAK} > 0")
def crest_db(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return signals(spark, d).filter(sig.peak(x) > 0).select("vec_id", F.round(sig.crest_db(x), 4).alias("crest"), F.round(sig.to_db(sig.rms(x)), 4).alias("level"))


@query(_S + "SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(x, lambda v: v - list_avg(x)), lambda v: v * v)) / len(x)), 6) AS rms_without_dc FROM s")
def dc_removed_stats(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("vec_id", F.round(sig.rms(sig.dc_removed(F.col("x"))), 6).alias("rms_without_dc"))


@query(_S + ", l AS (SELECT vec_id, unnest(range(8)) AS b, x FROM s) SELECT vec_id, b::INT AS block, round(greatest(-240, 20 * log10(sqrt(list_sum(list_transform(x[b * 8 + 1 : b * 8 + 8], lambda v: v * v)) / 8))), 4) AS db FROM l")
def block_rms_envelope(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("vec_id", F.posexplode(sig.block_rms_db(F.col("x"), 8)).alias("block", "db")).select("vec_id", "block", F.round("db", 4).alias("db"))


@query(_S + """
, l AS (SELECT vec_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM s), e AS (SELECT vec_id, i, sum(v * v) OVER w AS en, count(*) OVER w AS c FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT vec_id AS series, i::INT AS start FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(en, 6) DESC, i) AS r FROM e WHERE c = 16 AND i % 4 = 0) WHERE r = 1""")
def loudest_window(spark: SparkSession, d: str) -> DataFrame:
    samples = signals(spark, d).select(F.col("vec_id").alias("series"), F.posexplode("x").alias("i", "x"))
    return loudest(samples, 16, 4)


@query(_S + f"SELECT vec_id, round(CASE WHEN p > 0.3 THEN 0.25 ELSE p END, 6) AS peak_after, p > 0.3 AS touched FROM (SELECT vec_id, {_PEAK} AS p FROM s)")
def peak_clamp(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return signals(spark, d).select("vec_id", F.round(sig.peak(sig.peak_clamped(x, 0.3, 0.25)), 6).alias("peak_after"), (sig.peak(x) > 0.3).alias("touched"))


_PAIRED = SIGNALS.strip() + ", p AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)\n"
_DOT = "list_sum(list_transform(range(1, len(x) + 1), lambda i: {0}[i] * {1}[i]))"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {_PAIRED} SELECT vec_id, round({_DOT.format('x', 'y')} / {_DOT.format('x', 'x')}, 6) AS gain, round(({_DOT.format('x', 'y')} ^ 2) / ({_DOT.format('x', 'x')} * {_DOT.format('y', 'y')}), 6) AS explained FROM p")
def explained_energy(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _paired(spark, d).select("vec_id", F.round(sig.gain(x, y), 6).alias("gain"), F.round(sig.explained(x, y), 6).alias("explained"))


@query(f"""WITH {_PAIRED}, k AS (SELECT *, unnest(range(-4, 5)) AS k FROM p),
c AS (SELECT vec_id, k, round(list_sum(list_transform(range(greatest(1, 1 - k), least(len(x), len(x) - k) + 1), lambda i: x[i] * y[i + k])), 9) AS v FROM k)
SELECT vec_id, k::INT AS lag FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, abs(k), k DESC) AS r FROM c) WHERE r = 1""")
def lag_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("vec_id", sig.lag(F.col("x"), F.col("y"), 4).alias("lag"))


@query(f"""WITH {_PAIRED}, z AS (SELECT vec_id, x, y, list_transform(range(1, len(x) + 1), lambda i: (x[i] + y[i]) / 2) AS mono, list_transform(range(1, len(x) + 1), lambda i: y[i] - x[i]) AS rest FROM p)
SELECT vec_id, round(sqrt(list_sum(list_transform(mono, lambda v: v * v)) / len(mono)), 6) AS mono_rms, round(10 * log10(list_sum(list_transform(rest, lambda v: v * v)) / list_sum(list_transform(y, lambda v: v * v))), 4) AS residual_db, round(list_max(list_transform(rest, lambda v: abs(v))), 6) AS max_diff FROM z""")
def downmix_and_residual(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    rest = F.zip_with(x, y, lambda a, b: b - a)
    return _paired(spark, d).select("vec_id", F.round(sig.rms(sig.downmixed(x, y)), 6).alias("mono_rms"), F.round(10 * F.log10(sig.energy(rest) / sig.energy(y)), 4).alias("residual_db"), F.round(sig.peak(rest), 6).alias("max_diff"))


@query(_S + """
, l AS (SELECT label, vec_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS v FROM s), t AS (SELECT label, pos, sum(v) AS target FROM l GROUP BY ALL)
SELECT pos, round(sum(target), 4) AS mixture, round(max(abs(target)), 4) AS peak, count(*) AS classes FROM t GROUP BY pos""")
def class_sum_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Targets are sums of a class's members, the mixture is the sum of targets."""
    targets = signals(spark, d).select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.sum("v").alias("target"))
    return targets.groupBy("pos").agg(F.round(F.sum("target"), 4).alias("mixture"), F.round(F.max(F.abs("target")), 4).alias("peak"), F.count("*").alias("classes"))


@query(_S + """
, l AS (SELECT label, unnest(range(len(x)))::INT AS pos, unnest(x) AS v FROM s), m AS (SELECT pos, sum(v) AS mixture FROM l GROUP BY pos), t AS (SELECT pos, sum(t) AS targets FROM (SELECT label, pos, sum(v) AS t FROM l GROUP BY ALL) GROUP BY pos)
SELECT pos, round(mixture, 4) AS mixture, round(targets, 4) AS targets, true AS same FROM m JOIN t USING (pos)""")
def class_sum_identity(spark: SparkSession, d: str) -> DataFrame:
    """At every position the mixture of all members, the sum of the classes' targets, and whether they agree within 1e-4."""
    samples = signals(spark, d).select("label", F.posexplode("x").alias("pos", "v"))
    mixture = samples.groupBy("pos").agg(F.sum("v").alias("mixture"))
    targets = samples.groupBy("label", "pos").agg(F.sum("v").alias("t")).groupBy("pos").agg(F.sum("t").alias("targets"))
    return mixture.join(targets, "pos").select("pos", F.round("mixture", 4).alias("mixture"), F.round("targets", 4).alias("targets"), (F.abs(F.col("mixture") - F.col("targets")) <= 1e-4).alias("same"))


@query(_S + """
, n AS (SELECT vec_id, label, x[1 : len(x) - vec_id % 5] AS x FROM s), k AS (SELECT label, min(len(x)) AS k FROM n GROUP BY label),
l AS (SELECT label, vec_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS v FROM n), t AS (SELECT label, pos, sum(v) AS v FROM l JOIN k USING (label) WHERE pos < k GROUP BY ALL), p AS (SELECT label, max(abs(v)) AS peak, max(pos) + 1 AS kept FROM t GROUP BY label)
SELECT label, pos, kept, round(v * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 4) AS target FROM t JOIN p USING (label)""")
def trimmed_targets(spark: SparkSession, d: str) -> DataFrame:
    """Members of uneven length summed by class, trimmed to the shortest, and brought under 0.99 by one gain for the whole class."""
    x = F.slice("x", 1, (F.size("x") - F.col("vec_id") % 5).cast("int"))
    uneven = signals(spark, d).select(F.col("label").alias("song"), x.alias("x"))
    return trimmed_sum(uneven, ["song"], 0.99).select(F.col("song").alias("label"), "pos", "kept", F.round("v", 4).alias("target"))


@query("""
WITH q AS (SELECT role, peak AS p, rms AS r FROM audio_qc WHERE isfinite(peak) AND isfinite(rms))
SELECT role, CASE WHEN count(*) < 2 OR var_pop(p) = 0 OR var_pop(r) = 0 THEN 0.0 ELSE round(corr(p, r), 5) END AS corr FROM q GROUP BY role""")
def pearson_guarded(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "audio_qc").filter((F.abs("peak") < float("inf")) & (F.abs("rms") < float("inf")))
    constant = (F.count("*") < 2) | (F.var_pop("peak") == 0) | (F.var_pop("rms") == 0)
    return q.groupBy("role").agg(F.when(constant, 0.0).otherwise(F.round(F.corr("peak", "rms"), 5)).alias("corr"))


@query("""
WITH v AS (SELECT (role = 'clip') AS first, peak AS x FROM audio_qc WHERE isfinite(peak) AND role IN ('clip', 'stem')),
g AS (SELECT x, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM v GROUP BY x),
c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g),
n AS (SELECT count(*) FILTER (first) AS n_a, count(*) FILTER (NOT first) AS n_b FROM v), k AS (SELECT max(abs(fa - fb)) AS statistic, any_value(n_a) AS n_a, any_value(n_b) AS n_b FROM c CROSS JOIN n),
z AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * statistic AS z FROM k)
SELECT round(statistic, 6) AS statistic, round(CASE WHEN z < 1e-3 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * z * z))))) END, 6) AS p_value, n_a, n_b FROM z""")
def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "audio_qc").filter((F.abs("peak") < float("inf")) & F.col("role").isin("clip", "stem")).select((F.col("role") == "clip").alias("first"), F.col("peak").alias("x"))
    return ks(v).select(F.round("statistic", 6).alias("statistic"), (F.round("p_value", 6) + F.lit(0.0)).alias("p_value"), "n_a", "n_b")


_LOGP = "-ln(2 * pi()) - 0.5 * ln({0}.vp * {0}.vr - {0}.c * {0}.c) - 0.5 * ((p - {0}.mp) ^ 2 * {0}.vr - 2 * (p - {0}.mp) * (r - {0}.mr) * {0}.c + (r - {0}.mr) ^ 2 * {0}.vp) / ({0}.vp * {0}.vr - {0}.c * {0}.c)"
_GAUSS = """WITH q AS (SELECT path, dataset, role, peak AS p, 20 * log10(rms) AS r, checked_at FROM audio_qc WHERE isfinite(peak) AND rms > 0 AND isfinite(rms)),
a AS (SELECT avg(p) AS mp, avg(r) AS mr, var_samp(p) AS vp, var_samp(r) AS vr, covar_samp(p, r) AS c FROM q WHERE role = 'master'), b AS (SELECT avg(p) AS mp, avg(r) AS mr, var_samp(p) AS vp, var_samp(r) AS vr, covar_samp(p, r) AS c FROM q WHERE role = 'stem')
"""


def _measured(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "audio_qc").filter((F.abs("peak") < float("inf")) & (F.col("rms") > 0) & (F.col("rms") < float("inf")))
    return q.select("path", "dataset", "role", F.col("peak").alias("p"), (20 * F.log10("rms")).alias("r"), "checked_at")


@query(_GAUSS + f"""SELECT path, checked_at, log_odds, row_number() OVER (PARTITION BY dataset ORDER BY log_odds DESC, path, checked_at, r) AS rank_in_dataset, count(*) OVER (PARTITION BY dataset) AS sources_in_dataset
FROM (SELECT path, checked_at, dataset, r, round(({_LOGP.format('a')}) - ({_LOGP.format('b')}), 4) + 0.0::DOUBLE AS log_odds FROM q, a, b)""")
def gaussian_log_odds_rank(spark: SparkSession, d: str) -> DataFrame:
    """How much more a file's level and peak look like a master's than like a stem's. A ranking, not a verdict."""
    q = _measured(spark, d)
    scored = gaussian_log_odds(q, q.filter("role = 'master'"), q.filter("role = 'stem'"), "p", "r")
    shown = scored.select("path", "checked_at", "dataset", "r", (F.round("log_odds", 4) + F.lit(0.0)).alias("log_odds"))
    ranked = ordered_rank(shown, ["dataset"], [F.desc("log_odds"), F.asc("path"), F.asc("checked_at"), F.asc("r")], "rank_in_dataset", "sources_in_dataset")
    return ranked.select("path", "checked_at", "log_odds", "rank_in_dataset", "sources_in_dataset")


@query(_GAUSS + """SELECT role, round(avg(CASE WHEN ((p - a.mp) ^ 2 * a.vr - 2 * (p - a.mp) * (r - a.mr) * a.c + (r - a.mr) ^ 2 * a.vp) / (a.vp * a.vr - a.c * a.c) <= 5.991 THEN 1.0 ELSE 0.0 END), 4) AS inside FROM q, a GROUP BY role""")
def ellipse_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of each role inside the 95 % ellipse of the masters."""
    q = _measured(spark, d)
    scored = gaussian_log_odds(q, q.filter("role = 'master'"), q.filter("role = 'stem'"), "p", "r")
    return scored.groupBy("role").agg(F.round(F.avg((F.col("distance") <= 5.991).cast("double")), 4).alias("inside"))
