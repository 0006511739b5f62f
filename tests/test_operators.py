import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarloom.functions import signal as sig
from sonarloom.operators import quality as q
from sonarloom.operators.aggregate import class_loss, cumulative_below, tiered_reference
from sonarloom.operators.distribution import ks_two_sample
from sonarloom.operators.prefix import random_rank, running_sum
from sonarloom.operators.relational import channel_action, dedupe_latest, file_id, iqr_fence, join_one_to_one, lookup_strict
from sonarloom.operators.sampling import excerpt_start, matched_gain, reject_reserved, stratified_split, weighted_draw


def test_channel_rule(spark):
    rows = [(1, None, None), (2, 0.1, True), (2, 0.9999, False), (2, 0.9998, False), (2, -0.5, None), (2, -0.49, None), (2, None, None), (2, math.nan, False)]
    got = [r[0] for r in spark.createDataFrame(rows, "c int, r double, i boolean").select(channel_action(F.col("c"), F.col("r"), F.col("i"))).collect()]
    assert got == ["keep_mono", "pick_channel", "pick_channel", "keep_stereo", "pick_channel", "keep_stereo", "keep_stereo", "keep_stereo"]


def test_file_id(spark):
    got = [r[0] for r in spark.createDataFrame([("a/b/c/d.wav",), ("a/d.wav",), ("d.wav",)], "p string").select(file_id(F.lit("7"), F.col("p"))).collect()]
    assert got == ["7:c/d.wav", "7:d.wav", "7:d.wav"]


def test_percentiles_and_fence(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 8.0, 9.5)], "g string, x double")
    assert df.agg(F.percentile("x", [0.25, 0.5, 0.95])).head()[0] == pytest.approx([2.0, 4.0, 9.2])
    fence = spark.createDataFrame([(8.643,), (8.643,), (19.333,), (19.333,)], "x double").withColumn("g", F.lit("a"))
    assert iqr_fence(df, ["g"], "x", 3.0).head()["fence"] == pytest.approx(8 + 3 * 6)
    assert iqr_fence(fence, ["g"], "x", 3.0).head()["fence"] == pytest.approx(19.333 + 3 * (19.333 - 8.643))


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 9.9), ("a", None), ("b", None)], "g string, x double")
    assert [(r["g"], r["files"], r["files_below"]) for r in class_loss(df, "g", "x", 10.0).collect()] == [("a", 2, 1)]
    assert [(r["threshold"], r["files_below"]) for r in cumulative_below(df, [], "x", [10.0, 20.0]).collect()] == [(10.0, 1), (20.0, 2)]
    assert cumulative_below(df.limit(0), [], "x", [1.0]).count() == 0


def test_tiers(spark):
    rows = [(c, f"{c}{i}", float(i)) for c, n in (("c9", 9), ("c10", 10), ("c29", 29), ("c30", 30)) for i in range(n)]
    got = tiered_reference(spark.createDataFrame(rows, "g string, s string, v double"), spark.createDataFrame([("c9",), ("c10",), ("c29",), ("c30",), ("none",)], "g string"), "g", "s", "v", 30, 10)
    assert {r["g"]: r["tier"] for r in got.collect()} == {"c9": "pooled", "c10": "class_mean", "c29": "class_mean", "c30": "empirical", "none": "pooled"}


def test_stratified_quota(spark):
    rows = [(f"g{n}", f"{n}-{i}") for n in (1, 2, 3, 5, 21) for i in range(n)]
    got = stratified_split(spark.createDataFrame(rows, "g string, k string"), "g", "k", 0.15, 0.1, 42).groupBy("g").agg(F.count_if(F.col("split") == "test"), F.count_if(F.col("split") == "val")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"g1": (0, 0), "g2": (0, 1), "g3": (1, 1), "g5": (1, 1), "g21": (3, 2)}


def test_gain_excerpt_and_reserved(spark):
    rows = [(30.0, -20.0), (-25.0, -20.0), (0.0, -20.0), (0.0, -71.0), (0.0, None), (0.0, -math.inf)]
    got = [r[0] for r in spark.createDataFrame(rows, "r double, s double").select(matched_gain(F.col("r"), F.col("s"))).collect()]
    assert got[:3] == pytest.approx([10**1.25, 0.1, 1.0]) and got[3:] == [None] * 3
    starts = spark.createDataFrame([(5.0, 0.5, 1000), (0.0, 1.0, 1000), (9.9, 0.0, 100), (9.0, 0.0, 1000)], "a double, b double, n int").select(excerpt_start(F.col("a"), F.col("b"), 4.0, 100, F.col("n")))
    assert [r[0] for r in starts.collect()] == [300, 0, 0, 600]
    with pytest.raises(NotImplementedError):
        reject_reserved({"multi_sample": 2})


def test_weighted_draw_ends(spark):
    draws = spark.createDataFrame([(0.0,), (0.24,), (0.25,), (0.999999,)], "u double")
    choices = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "v string, w double")
    assert [r["v"] for r in weighted_draw(draws, "u", choices, "v", "w").orderBy("u").collect()] == ["a", "a", "b", "b"]


def test_ks_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=200), 1), np.round(rng.normal(0.3, size=150), 1)
    rows = [(True, float(x)) for x in a] + [(False, float(x)) for x in b] + [(True, None)]
    got = ks_two_sample(spark.createDataFrame(rows, "first boolean, x double")).head()
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert got["statistic"] == pytest.approx(want) and (got["n_a"], got["n_b"]) == (200, 150) and 0 < got["p_value"] < 1


def test_signal_kernels(spark):
    x, y = np.array([0.0, 0.5, -1.0, 0.25]), np.array([0.1, 0.4, -0.9, 0.2])
    df = spark.createDataFrame([(x.tolist(), y.tolist(), [1.0] * 4)], "x array<double>, y array<double>, c array<double>")
    X, Y, C = F.col("x"), F.col("y"), F.col("c")
    got = df.select(sig.rms(X), sig.peak(X), sig.gain(X, Y), sig.explained(X, Y), sig.correlation(X, Y), sig.correlation(C, C), sig.correlation(C, X), sig.block_rms_db(X, 3), sig.lag(X, Y, 2), sig.peak(sig.peak_clamped(X, 0.9, 0.5)), sig.rms(sig.dc_removed(C)), sig.crest_db(sig.dc_removed(C))).head()
    assert got[0] == pytest.approx(np.sqrt((x**2).mean())) and got[1] == 1.0
    assert got[2] == pytest.approx((x @ y) / (x @ x)) and got[3] == pytest.approx((x @ y) ** 2 / ((x @ x) * (y @ y)))
    assert got[4] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[5] == 1.0 and got[6] == 0.0
    assert got[7] == pytest.approx([10 * np.log10((x[:3] ** 2).mean())]) and got[8] == 0 and got[9] == pytest.approx(0.5) and got[10] == 0.0 and got[11] is None
    empty = spark.createDataFrame([([],), (None,)], "x array<double>").select(sig.rms(X), sig.peak(X), sig.block_rms_db(X, 3)).collect()
    assert empty[0][0] is None and empty[0][1] is None and empty[0][2] == []


def test_ranks_and_sums_in_buckets(spark, monkeypatch):
    monkeypatch.setattr("sonarloom.operators.prefix.BUCKET", 10)
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("g")).withColumn("g", F.when(F.col("g") != "2", F.col("g")))
    ranked = random_rank(df, ["g"], ["id"], 1).collect()
    for g in ("0", "1", None):
        assert sorted(r["rank"] for r in ranked if r["g"] == g) == list(range(1, sum(r["g"] == g for r in ranked) + 1))
    placed = running_sum(df.withColumn("u", F.col("id") / 100), [], "u", ["id"], F.col("id")).orderBy("id").collect()
    assert [r["before"] for r in placed] == [sum(range(i)) for i in range(100)]


def test_checked_joins(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in join_one_to_one(left, right, ["k"]).collect()) == [(1, "a"), (2, "b")]
    for bad in (right.unionByName(right), right.filter("k = 1")):
        with pytest.raises(Exception, match="not one partner"):
            join_one_to_one(left, bad, ["k"]).collect()
    assert lookup_strict(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="no entry"):
        lookup_strict(left, right.filter("k = 1"), ["k"]).collect()


def test_dedupe_latest(spark):
    rows = [("a", datetime(2024, 1, 1), 1), ("a", datetime(2024, 1, 2), 2), ("a", datetime(2024, 1, 2), 3), ("b", None, 4)]
    got = dedupe_latest(spark.createDataFrame(rows, "k string, t timestamp_ntz, v int"), ["k"], ["t"]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", 3), ("b", 4)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 44100, 1.0), (1, 48000, 2.0), (None, 44100, None)], "k int, sr int, x double")
    assert q.not_unique(df, ["k"]).count() == 1 and q.not_constant(df, "sr").count() == 1 and q.incomplete(df, ["k", "x"]).count() == 1
    assert [r[0] for r in q.unmatched(df, spark.createDataFrame([(2,)], "k int"), ["k"]).collect()] == [1]
    q.demand_none(df.filter("k = 7"), "nothing")
    with pytest.raises(q.Violated):
        q.demand_none(q.not_constant(df, "sr"), "one rate")
