from collections import Counter

from pyspark.sql import functions as F

from sonarloom.operators import sequence as seq
from sonarloom.operators.sampling import drawn_segment
from sonarloom.plans.base import envelopes
from sonarloom.plans.samplers import RATE, WINDOW_S, activity_excerpt_plan
from sonarloom.plans.sequences import BLOCK_S, RULES
from sonarloom.session import table


def test_segments_are_drawn_by_length(spark):
    rows = [(f"s{k}", k / 1000, a, b) for k in range(1000) for a, b in ((2, 3), (10, 16), (20, 23))]
    got = drawn_segment(spark.createDataFrame(rows, "series string, u double, start int, end int"), F.col("u")).collect()
    assert len(got) == 1000 and Counter(r["start"] for r in got) == {2: 100, 10: 600, 20: 300}


def test_excerpts_touch_activity(spark, sf):
    plan = {r["file_id"]: r["start_frame"] / RATE for r in activity_excerpt_plan(spark, sf).collect()}
    frames = dict(table(spark, sf, "source_manifest").filter("out_frames > 0").groupBy("file_id").agg(F.max("out_frames")).collect())
    active: dict = {}
    for r in seq.segments(envelopes(spark, sf), RULES).collect():
        active.setdefault(r["series"], []).append((r["start"] * BLOCK_S, r["end"] * BLOCK_S))
    assert plan.keys() == active.keys() & frames.keys() and plan
    for k, start in plan.items():
        inside = [(a, b) for a, b in active[k] if a < frames[k] / RATE]
        assert len(inside) < len(active[k]) or any(a - 1e-4 <= start + WINDOW_S and start <= b + 1e-4 for a, b in inside)
