import random

from pyspark.sql import functions as F

from sonarloom.operators import sequence as seq
from sonarloom.operators.sequence import SegmentRules

RULES = SegmentRules()


def frame(spark, series):
    return spark.createDataFrame([(s, i, x) for s, xs in series.items() for i, x in enumerate(xs)], "series string, block int, db double")


def machine(env, r):
    """An independent state machine, one block at a time."""
    out, start, opened = [], None, False
    for i, x in enumerate([*env, None]):
        if x is not None and x > r.close_db:
            start = i if start is None else start
            opened |= x >= r.open_db
        elif start is not None:
            if opened:
                out.append([start, i])
            start, opened = None, False
    joined = []
    for a, b in out:
        if joined and a - joined[-1][1] < r.min_gap:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    kept = [[a, min(b + r.release, len(env))] for a, b in joined if b - a >= r.min_length]
    final = []
    for a, b in kept:
        if final and a <= final[-1][1]:
            final[-1][1] = max(final[-1][1], b)
        else:
            final.append([a, b])
    return [tuple(x) for x in final]


def found(spark, series, rules=RULES):
    rows = seq.segments(frame(spark, series), rules).orderBy("series", "start").collect()
    return {s: [(r["start"], r["end"]) for r in rows if r["series"] == s] for s in series}


def test_boundaries(spark):
    quiet, loud = -240.0, -50.0
    series = {
        "thresholds": [-70.0, -69.9, -60.0, -70.0] + [quiet] * 9,
        "not opened": [-69.9, -60.1, -69.9] + [quiet] * 9,
        "gap 3": [loud] * 3 + [quiet] * 3 + [loud] * 3 + [quiet] * 9,
        "gap 4": [loud] * 3 + [quiet] * 4 + [loud] * 3 + [quiet] * 9,
        "blips": [loud] + [quiet] * 9 + [loud] * 2 + [quiet] * 9,
        "tail": [quiet] * 3 + [loud] * 3 + [quiet] * 2,
        "silent": [quiet] * 20,
    }
    got = found(spark, series)
    assert got == {s: machine(x, RULES) for s, x in series.items()}
    assert got["thresholds"] == [(1, 8)] and got["not opened"] == [] and got["silent"] == []
    assert got["tail"] == [(3, 8)] and got["blips"] == [(10, 17)]


def test_random_series(spark):
    rng = random.Random(5)
    series = {f"s{k}": [rng.choice([-240.0, -75.0, -70.0, -65.0, -60.0, -40.0]) for _ in range(rng.randrange(1, 60))] for k in range(120)}
    for rules in (RULES, SegmentRules(-60, -70, 1, 1, 0), SegmentRules(-60, -70, 3, 3, 2)):
        assert found(spark, series, rules) == {s: machine(x, rules) for s, x in series.items()}


def test_empty_and_null(spark):
    assert seq.segments(frame(spark, {}), RULES).count() == 0
    assert found(spark, {"n": [None, -50.0, -50.0, None]}) == {"n": [(1, 4)]}


def test_gaps_edges_runs_invariant(spark):
    blocks = frame(spark, {"a": [-50.0] * 3 + [-240.0] * 12 + [-50.0] * 3, "b": [-240.0] * 4})
    segs = seq.segments(blocks, RULES)
    assert [tuple(r) for r in seq.gaps(segs).collect()] == [("a", 8, 7)]
    assert {r[0]: (r[1], r[2]) for r in seq.edge_silence(blocks, F.col("db") > -60).collect()} == {"a": (0, 0), "b": (4, 0)}
    assert {r[0]: r[1] for r in seq.longest_run(blocks, F.col("db") > -60).collect()} == {"a": 3, "b": 0}
    assert seq.undershoot(blocks, RULES).count() == 0


def test_coverage_unites_members_and_drops_the_rest(spark):
    members = spark.createDataFrame([("s", "x", 0, 4), ("s", "x", 2, 6), ("s", "y", 9, 13)], "song string, class string, start int, end int")
    lengths = spark.createDataFrame([("s", 13)], "song string, n int")
    got = {(r["window_idx"], r["class"]): r["covered"] for r in seq.coverage(members, lengths, {"w": 6}).collect()}
    assert got == {(0, "x"): 1.0, (1, "x"): 0.0, (0, "y"): 0.0, (1, "y"): 0.5}


def test_rules_from_seconds():
    assert SegmentRules.from_seconds(0.046, 0.20, 0.10, 0.25, -60, -70) == RULES
    assert [round(x / 0.046) for x in (3, 6, 8, 10)] == [65, 130, 174, 217]
