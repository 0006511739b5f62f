"""Queries of the percentile sketches, and SQL for the exact percentiles.

p3_percentiles equals its SQL where no group has over BUFFERS x SIZE values (26,000): sketches are exact up to
there. p3_within_bound uses sketches so small that they collapse on any table, and holds each against exact ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.functions.text import compared, compared_sql
from sonarloom.llm.quantiles import SIZE, merge_sketches, percentiles, sketches
from sonarloom.operators.skew import same
from sonarloom.session import cut, table

SHARES = [0.25, 0.5, 0.75, 0.95]
GROUP = ["dataset", "stem_group"]


def _key(column: str) -> Column:
    return F.lower(compared(F.col(column)))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").select(_key("dataset").alias("dataset"), _key("stem_group").alias("stem_group"), F.date_format("ingested_at", "yyyy-MM").alias("period"), "out_duration")


def _activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activity_summary").select(F.lit("").alias("dataset"), _key("stem_group").alias("stem_group"), F.col("scan_date").cast("string").alias("period"), "seg_p50_s", "gap_p95_s")


def _kept(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    """The sketches that are kept: per day of the summary, per month of ingestion."""
    periods = ["period", *GROUP]
    activity = sketches(_activity(spark, d), periods, {"seg_p50_s": F.col("seg_p50_s"), "gap_p95_s": F.col("gap_p95_s")}, size)
    return cut(sketches(_durations(spark, d), periods, {"out_duration": F.col("out_duration")}, size).unionByName(activity), "kept")


def _whole(kept: DataFrame, size: int = SIZE) -> DataFrame:
    """The sketches of the whole, combined from those of the periods."""
    return merge_sketches(kept.withColumn("slot", F.pmod(F.xxhash64("period"), F.lit(1024)).cast("int")).drop("period"), GROUP, size)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p25, p50, p75, p95 of out_duration per dataset and stem group, of seg_p50_s and gap_p95_s per stem group.

    For each day or month by itself, and, with a null period, for the whole, combined from these.
    """
    kept = _kept(spark, d)
    whole = percentiles(_whole(kept), GROUP, SHARES).withColumn("period", F.lit(None).cast("string"))
    return percentiles(kept, ["period", *GROUP], SHARES).unionByName(whole)


#: Buffers so small that they collapse on any table, and the share of ranks by which their answers may be off.
SMALL, MOST_OFF = 16, 0.25


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """For each percentile the exact values MOST_OFF of all ranks below and above it, and whether the answer of collapsed sketches lies between, within its own stated bound."""
    group = [*GROUP, "measure"]
    answers = cut(percentiles(_whole(_kept(spark, d, SMALL), SMALL), GROUP, SHARES, SMALL), "percentiles")
    cell = F.struct
    durations = _durations(spark, d).select(*GROUP, F.lit("out_duration").alias("measure"), F.col("out_duration").alias("x"))
    activity = _activity(spark, d).select(*GROUP, F.inline(F.array(cell(F.lit("seg_p50_s").alias("measure"), F.col("seg_p50_s").alias("x")), cell(F.lit("gap_p95_s").alias("measure"), F.col("gap_p95_s").alias("x")))))
    counts = durations.unionByName(activity).filter(F.abs("x") < float("inf")).groupBy(*group, "x").agg(F.count("*").alias("c"))
    # Equal values hold a stretch of ranks; a window over a group's distinct values is enough for this check.
    w = Window.partitionBy(*group)
    upto = F.sum("c").over(w.orderBy("x"))
    ranked = counts.select(*group, "x", (upto - F.col("c") + 1).alias("first"), upto.alias("last"), F.sum("c").over(w).alias("n_values"))
    asked = [F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n_values"))).alias("k")) for s in SHARES]
    off = F.floor(F.lit(MOST_OFF) * F.col("n_values"))
    lowest, highest = F.greatest(F.lit(1), F.col("k") - off), F.least("n_values", F.col("k") + off)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("x")))

    exact = ranked.select("*", F.inline(F.array(*asked))).groupBy(*group, "share", "n_values", "k").agg(at(lowest).alias("low"), at(highest).alias("high"), at(F.col("k")).alias("exact"))
    good = (answers["n"] == exact["n_values"]) & (answers["value"] >= exact["low"]) & (answers["value"] <= exact["high"]) & (answers["rank_error"] <= MOST_OFF * exact["n_values"])
    return exact.join(answers, same(exact, answers, [*group, "share"]), "left").select(*[exact[c] for c in [*group, "share", "n_values", "low", "exact", "high"]], F.coalesce(good, F.lit(False)).alias("within_bound"))


_SUMMARY = f"SELECT '' AS dataset, lower({compared_sql('stem_group')}) AS stem_group, strftime(scan_date, '%Y-%m-%d') AS period, '{{0}}' AS measure, {{0}} AS x FROM activity_summary"
_VALUES = f"""
WITH v AS (SELECT * FROM (
  SELECT lower({compared_sql('dataset')}) AS dataset, lower({compared_sql('stem_group')}) AS stem_group, strftime(ingested_at, '%Y-%m') AS period, 'out_duration' AS measure, out_duration AS x FROM source_manifest
  UNION ALL {_SUMMARY.format('seg_p50_s')} UNION ALL {_SUMMARY.format('gap_p95_s')}
) WHERE isfinite(x)), shares AS (SELECT unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS share)
"""

QUERIES = {"p3_percentiles": p3_percentiles, "p3_within_bound": p3_within_bound}
SQL = {
    "p3_percentiles": _VALUES + """,
both_levels AS (SELECT dataset, stem_group, period, measure, x FROM v UNION ALL SELECT dataset, stem_group, NULL, measure, x FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, stem_group, period, measure ORDER BY x) AS r, count(*) OVER (PARTITION BY dataset, stem_group, period, measure) AS n FROM both_levels)
SELECT dataset, stem_group, period, measure, share, n, x AS value, 0.0::DOUBLE AS rank_error FROM r JOIN shares ON r = greatest(1, ceil(share * n))
""",
    "p3_within_bound": _VALUES + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, stem_group, measure ORDER BY x) AS r, count(*) OVER (PARTITION BY dataset, stem_group, measure) AS n FROM v),
k AS (SELECT r.*, share, greatest(1, ceil(share * n)) AS k, floor({MOST_OFF} * n) AS off FROM r CROSS JOIN shares)
SELECT dataset, stem_group, measure, share, n AS n_values, max(x) FILTER (r = greatest(1, k - off)) AS low, max(x) FILTER (r = k) AS exact, max(x) FILTER (r = least(n, k + off)) AS high, true AS within_bound
FROM k GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY dataset, stem_group, measure, share, n"),
}
