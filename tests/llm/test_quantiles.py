import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarloom.llm import quantiles
from sonarloom.llm.quantiles import Sketch, merge_sketches, percentiles, size_for, sketches

SHARES = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def off(values, found, share):
    ordered = np.sort(values)
    wanted = max(1, math.ceil(share * len(ordered)))
    low, high = np.searchsorted(ordered, found) + 1, np.searchsorted(ordered, found, side="right")
    return max(0, low - wanted, wanted - high)


@pytest.mark.parametrize("kind", ["normal", "sorted", "reversed", "ties", "heavy"])
def test_bound_holds_and_is_small(kind):
    rng = np.random.default_rng(2)
    n = 400_000
    x = {"normal": rng.normal(size=n), "sorted": np.arange(n, dtype=float), "reversed": -np.arange(n, dtype=float), "ties": rng.integers(0, 5, n).astype(float), "heavy": rng.pareto(0.7, n)}[kind]
    one = Sketch()
    one.add(x)
    merged = Sketch()
    for part in np.array_split(x, 37):
        s = Sketch()
        s.add(part)
        merged.merge(**s.state())
    for sketch in (one, merged):
        found, error = sketch.quantiles(SHARES)
        assert sketch.n == n and error <= 0.01 * n and len(sketch.buffers) <= 10
        assert all(off(x, v, p) <= error for v, p in zip(found, SHARES))


def test_small_inputs_are_exact():
    s = Sketch()
    s.add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0.0, 0.5, 1.0]) == ([1.0, 2.0, 3.0], 0.0)
    assert Sketch().quantiles([0.5]) == ([None], 0.0)


def test_spark_days_combine(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 9), "a" if i % 3 else None, float(v), "x", 1) for i, v in enumerate(rng.normal(size=30_000))]
    rows += [(0, "a", v, "x", 1) for v in (math.nan, math.inf, -math.inf, None)] + [(0, "empty", None, "x", 1)]
    df = spark.createDataFrame(rows, "day int, g string, v double, measure string, slot int").repartition(6)
    days = sketches(df, ["day", "g"], {"v": F.col("v")}, size=128)
    whole = merge_sketches(days.drop("day"), ["g"], size=128)
    got = percentiles(whole, ["g"], SHARES, size=128).collect()
    assert {r["g"] for r in got} == {"a", None}
    for r in got:
        x = np.array([v for _, g, v, *_ in rows if g == r["g"] and v is not None and math.isfinite(v)])
        assert r["n"] == len(x) and off(x, r["value"], r["share"]) <= r["rank_error"] <= 0.15 * len(x)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(sketches(df, ["g"], {"v": F.col("v")}), ["g"], SHARES).count() == 0


@pytest.mark.parametrize("epsilon", [0.2, 0.05, 0.01])
def test_epsilon_is_kept(epsilon):
    """The stated bound, and so the true error, stays within epsilon of all ranks, in one sketch and in a merged tree."""
    x = np.random.default_rng(6).lognormal(size=1_500_000)
    size = size_for(epsilon)
    parts = []
    for part in np.array_split(x, 64):
        parts.append(Sketch(size))
        parts[-1].add(part)
    while len(parts) > 1:
        for s in parts[1::2]:
            parts[parts.index(s) - 1].merge(**s.state())
        parts = parts[::2]
    found, error = parts[0].quantiles(SHARES)
    assert 0 < error <= epsilon * len(x) and all(off(x, v, p) <= error for v, p in zip(found, SHARES))


def test_many_groups_are_handed_on(spark, monkeypatch):
    """A task that meets more groups than it may hold hands its sketches on, and loses nothing."""
    monkeypatch.setattr(quantiles, "HELD", 500)
    df = spark.range(20_000).select((F.col("id") % 400).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: (r["n"], r["value"]) for r in percentiles(sketches(df, ["g"], {"v": F.col("v")}), ["g"], [0.5]).collect()}
    assert got == {str(g): (50, float(g + 400 * 24)) for g in range(400)}
