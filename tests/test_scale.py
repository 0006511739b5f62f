"""Operators whose groups may hold half of all rows: the same results by the other way."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonarloom.functions import signal as sig
from sonarloom.operators import matching as m
from sonarloom.operators.aggregate import exact_percentiles
from sonarloom.operators.mixture import trimmed_sum
from sonarloom.operators.relational import complete_map, in_order_of, lookup_default, short_name, slotted, with_files
from sonarloom.operators.sampling import MAX_CHOICES, stratified_split, weighted_draw


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=4000), 2)] + [(None, float(v)) for v in rng.normal(size=301)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], F.col("x"), {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).collect()}
    assert got.keys() == {"hot", None, "one", "two"}
    for g, r in got.items():
        x = [v for k, v in rows if k == g and v is not None]
        assert r["_n"] == len(x) and [r[c] for c in "abcde"] == pytest.approx(np.percentile(x, [0, 25, 50, 95, 100]).tolist())
    assert exact_percentiles(df, [], F.col("x"), {"p": 0.5}).head()["p"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert exact_percentiles(df.limit(0), ["g"], F.col("x"), {"p": 0.5}).count() == 0


def test_stratified_split_of_a_hot_stratum(spark, monkeypatch):
    df = spark.createDataFrame([("hot" if i % 2 else f"g{i % 40}", f"k{i}") for i in range(2000)] + [(None, "n1"), (None, "n2"), (None, "n3")], "g string, k string")
    want = {r["k"]: r["split"] for r in stratified_split(df, "g", "k", 0.15, 0.1, 42).collect()}
    monkeypatch.setattr("sonarloom.operators.prefix.BUCKET", 50)
    monkeypatch.setattr("sonarloom.operators.skew.LEAST", 100)
    got = stratified_split(df, "g", "k", 0.15, 0.1, 42)
    assert got.columns == ["g", "k", "split"] and {r["k"]: r["split"] for r in got.collect()} == want
    assert {r[0]: r[1] for r in got.filter("g = 'hot'").groupBy("split").count().collect()} == {"test": 150, "val": 100, "train": 750}


def test_pool_pick_is_even(spark):
    pool = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 99)], "class string, k int")
    draws = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise(F.when(F.col("id") % 4 == 1, "b").otherwise("none")).alias("class"), (F.col("id") / 1000).alias("u"))
    got = m.pool_pick(draws, pool, "class", ["k"], 1, "u", ["k"]).collect()
    counts = pd.Series([r["k"] for r in got if r["class"] == "a"]).value_counts()
    assert len(got) == 750 and set(counts) == {50} and {r["k"] for r in got if r["class"] == "b"} == {99}


def test_targets_by_tier(spark):
    windows = spark.createDataFrame([("full", f"s{i}", -20.0 - i % 7) for i in range(40)] + [("mean", f"t{i}", -30.0) for i in range(12)] + [("few", "u", -5.0)], "class string, source string, db double")
    tiers = m.reference(windows, spark.createDataFrame([("full",), ("mean",), ("few",), ("none",)], "class string"), 30, 10)
    draws = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, ("full", "mean", "few"))), (F.col("id") % 3 + 1).cast("int")).alias("class"), *[(F.pmod(F.xxhash64("id", F.lit(t)), F.lit(10_000)) / 10_000).alias(f"u_{t}") for t in ("pick", "jitter", "a", "b")])
    got = m.draw_targets(draws, tiers, windows, ["source"], 3).toPandas()
    assert len(got) == 3000
    by = got.groupby("class")["target_db"]
    assert by.min()["full"] >= -26.5 and by.max()["full"] <= -19.5 and by.mean()["full"] == pytest.approx(-23, abs=0.3)
    pooled = np.array([r["db"] for r in windows.collect()])
    assert by.mean()["mean"] == pytest.approx(-30, abs=0.6) and by.std()["mean"] == pytest.approx(pooled.std(), rel=0.1)
    assert by.mean()["few"] == pytest.approx(pooled.mean(), abs=0.6)


def test_offsets_levels_and_gains(spark):
    measured = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 4.0), ("a", "y", -3.0)], "dataset string, class string, off_db double")
    grid = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "dataset string, class string")
    assert {(r[0], r[1]): r[2] for r in m.window_offsets(measured, grid).collect()} == {("a", "x"): 3.0, ("a", "y"): -3.0, ("b", "x"): 1.0}
    assert {r[2] for r in m.window_offsets(measured.limit(0), grid).collect()} == {0.0}
    rows = [(-20.0, 1, 1.0, 6.0, True), (-20.0, 2, None, 6.0, False), (-80.0, 2, 0.0, 6.0, True), (None, 2, 0.0, 6.0, True), (-20.0, 2, 0.0, 40.0, True)]
    df = spark.createDataFrame(rows, "db double, ch int, off double, req double, on boolean")
    got = df.select(m.level_as_drawn(F.col("db"), F.col("ch"), F.col("off")), m.stem_gain(F.col("req"), F.col("db"), F.col("on"), F.lit(0.5)), m.outcome(F.col("req"), F.col("db"))).collect()
    assert got[0][0] == pytest.approx(-19 + 10 * math.log10(2)) and got[1][0] == -20.0 and got[3][0] is None
    assert [r[1] for r in got] == pytest.approx([0.75 * 10 ** (6 / 20), 0.75, 0.75, 0.75, 0.75 * 10 ** (25 / 20)])
    assert [r[2] for r in got] == ["matched", "matched", "unmeasurable", "unmeasurable", "clamped"]


def test_too_many_choices(spark):
    draws = spark.createDataFrame([(0.5,)], "u double")
    choices = spark.range(MAX_CHOICES + 1).select(F.col("id").alias("v"), F.lit(1.0).alias("w"))
    with pytest.raises(Exception, match="choices"):
        weighted_draw(draws, "u", choices, "v", "w").collect()


def test_lookups_with_defaults_orders_and_slots(spark):
    left, right = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert {r["k"]: r["v"] for r in lookup_default(left, right, ["k"], "v", F.lit(-1)).collect()} == {"a": 2, "b": -1, "c": -1, None: -1}
    listing = spark.createDataFrame([("x/a.wav",), ("y/a.wav",), ("x/z.wav",)], "path string")
    assert [r["k"] for r in with_files(left, listing, "k", F.regexp_extract("path", r"([^/]*)\.wav$", 1)).collect()] == ["a"]
    order = spark.createDataFrame([("b", 1), ("a", 2)], "k string, pos int")
    assert [r["k"] for r in in_order_of(left.filter("k is not null"), order, ["k"], "pos").collect()] == ["b", "a", "c"]
    assert {r["k"]: r["slot"] for r in slotted(left, "k", ["b", "a"]).collect()} == {"a": 1, "b": 0, "c": None, None: None}
    with pytest.raises(ValueError):
        slotted(left, "k", ["b", "a"], ["a", "b"])
    assert {r["k"]: r["v"] for r in complete_map(spark.createDataFrame([("a", "x"), ("a", "x")], "k string, v string"), "k", "v").collect()} == {"a": "x"}
    for bad in ([("a", "x"), ("a", "y")], [("a", None)]):
        with pytest.raises(Exception, match="not one value"):
            complete_map(spark.createDataFrame(bad, "k string, v string"), "k", "v").collect()
    assert [r[0] for r in spark.createDataFrame([("pre_a_b",), ("a_b",), ("c",)], "n string").select(short_name(F.col("n"), F.lit("pre_"))).collect()] == ["a_b", "b", "c"]


def test_trimmed_sum(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [1.0, -4.0]), (None, [0.5]), ("b", None), ("c", [])], "g string, x array<double>")
    got = trimmed_sum(df, ["g"], 0.99).collect()
    assert {(r["g"], r["pos"]): (round(r["v"], 6), r["kept"]) for r in got} == {("a", 0): (0.99, 2), ("a", 1): (-0.99, 2), (None, 0): (0.5, 1)}
    assert {(r["g"], r["pos"]): r["v"] for r in trimmed_sum(df, ["g"]).collect()}[("a", 0)] == 2.0


def test_more_kernels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000)
    y = np.concatenate([np.zeros(37), x])[:3000] + 0.01 * rng.normal(size=3000)
    df = spark.createDataFrame([(x.tolist(), y.tolist()), ([1.0, 1.0], [1.0, 1.0 + 1e-9]), ([], [1.0]), (None, [1.0])], "x array<double>, y array<double>")
    X, Y = F.col("x"), F.col("y")
    rows = df.select(sig.lag(X, Y, 50), sig.lag(X, Y, 50, 1000), sig.sample_digest(X), sig.close_to(X, Y), sig.decimated(X, 7), sig.centred(X, 9), sig.prefix_energy(F.slice(X, 1, 5)), sig.to_stereo(F.array(X)), sig.picked_channel(F.array(X, Y), 1), sig.mono_envelope_db(F.array(X, Y), 100)).collect()
    a = rows[0]
    assert a[0] == a[1] == 37 and len(a[2]) == 32 and not a[3] and np.allclose(a[4], x[::7]) and np.allclose(a[5], x[1495:1504]) and np.allclose(a[6], np.concatenate([[0], np.cumsum(x[:5] ** 2)]))
    assert len(a[7]) == 2 and a[8] == [y.tolist()] and np.allclose(a[9], 20 * np.log10(np.sqrt((((x + y) / 2).reshape(-1, 10) ** 2).mean(1))))
    assert rows[1][2] is None and rows[1][3] and rows[2][0] is None and rows[3][0] is None and rows[2][2] is None
