import random

from sonarloom.llm.sampling import fitted, joint_sample, proportional_sample, refilled, seats

FILES = "file_id string, kind string, area string, category string, rank int"
TARGETS = "category_field string, category string, target_share double, min_files int, seats int"


def by_priority(available, shares, floors, size):
    first = [min(f, n) for f, n in zip(floors, available)]
    out = list(first)
    rest = sorted(((r - 0.5) / s, k) for k, (n, s, f) in enumerate(zip(available, shares, first)) if s > 0 for r in range(f + 1, n + 1))
    for _, k in rest[: max(0, size - sum(first))]:
        out[k] += 1
    return out


def test_seats_are_the_smallest_priorities():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randrange(1, 6)
        args = [rng.randrange(0, 30) for _ in range(k)], [rng.choice([0.0, 0.1, 0.25, 0.3, 0.5]) for _ in range(k)], [rng.randrange(0, 4) for _ in range(k)], rng.randrange(0, 60)
        got, want = seats(*args), by_priority(*args)
        assert sum(got) == sum(want)
        cut = lambda out: max(((r - 0.5) / s for n, s in zip(out, args[1]) if s > 0 for r in [n] if n), default=0)
        assert got == want or abs(cut(got) - cut(want)) < 1e-9  # they may differ in which of several ties is taken


def test_sample_and_report(spark):
    rows = [(f"f{i}", "A " if i % 2 else "a", "big" if i < 90 else "rare", "clash", 7) for i in range(100)]
    rows += rows[:30] + [("f1", "b", "big", "clash", 7), (None, "a", "big", "c", 1), ("f200", None, None, None, None)]
    targets = [("kind", "A", 0.5, 1, 0), ("kind", "B", 0.5, 1, 0), ("area", "Big", 0.9, 1, 0), ("area", "rare", 0.1, 8, 0), ("area", "gone", 0.0, 0, 0), ("area", None, None, None, None)]
    sample, report = proportional_sample(spark.createDataFrame(rows, FILES), spark.createDataFrame(targets, TARGETS), 0.2, 3)
    got = {(r["category_field"], r["category"]): r for r in report.collect()}
    assert {k: (r["available"], r["enough"]) for k, r in got.items()} == {("kind", "A"): (100, True), ("kind", "B"): (1, False), ("area", "Big"): (90, True), ("area", "rare"): (10, True), ("area", "gone"): (0, True), ("area", None): (0, True)}
    assert got["area", "rare"]["drawn"] == 8 and got["area", "Big"]["drawn"] == 12 and got["kind", "A"]["drawn"] == 19
    drawn = sample.collect()
    assert len(drawn) == len({(r["category_field"], r["category"], r["file_id"]) for r in drawn}) == 40
    again = proportional_sample(spark.createDataFrame(rows[::-1], FILES), spark.createDataFrame(targets, TARGETS), 0.2, 3)[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, drawn), key=str)


def test_empty(spark):
    files, targets = spark.createDataFrame([], FILES), spark.createDataFrame([("kind", "a", 1.0, 3, 0)], TARGETS)
    sample, report = proportional_sample(files, targets)
    assert sample.count() == 0 and [r["enough"] for r in report.collect()] == [False]
    assert proportional_sample(files, targets.limit(0))[1].count() == 0


def test_fit_reaches_all_margins():
    cells, have = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], [100, 10, 40, 80]
    x = fitted(cells, have, [{"a": 30.0, "b": 30.0}, {"x": 20.0, "y": 40.0}])
    assert abs(x[0] + x[1] - 30) < 0.2 and abs(x[0] + x[2] - 20) < 0.2 and all(v <= h for v, h in zip(x, have))
    assert abs(fitted(cells, have, [{"a": 200.0}, {}])[:2].sum() - 110) < 0.01


def test_refill():
    assert refilled({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}, 60) == {"a": 10.0, "b": 30.0, "c": 20.0}
    assert refilled({"a": 0.9, "b": 0.1, "z": 0.0}, {"a": 100, "b": 100, "z": 5}, {"a": 1, "b": 8, "z": 2}, 20) == {"a": 10.0, "b": 8.0, "z": 2.0}
    assert refilled({"a": 0.5}, {"a": 3}, {"a": 9}, 60) == {"a": 3.0} and refilled({}, {}, {}, 5) == {}


def test_joint_sample(spark):
    rng = random.Random(8)
    rows = [(f"f{i}", rng.choice(["a", "A ", "b"]), rng.choice(["x", "y", "y", "Y"]), "clash", i) for i in range(600)]
    rows += [("f1", "b", "x", "clash", -1), ("n1", None, "x", "c", 1), ("n2", "other", "x", "c", 1), (None, "a", "x", "c", 1)] + rows[:50]
    targets = [("kind", "A", 0.3, 5, 0), ("kind", "b", 0.7, 5, 0), ("area", "x", 0.5, 5, 0), ("area", "y", 0.5, 5, 0), ("area", "gone", 0.0, 2, 0), (None, "z", 1.0, 1, 0)]
    sample, report = joint_sample(spark.createDataFrame(rows, FILES), spark.createDataFrame(targets, TARGETS), 0.2, 3, latest="rank")
    got = {r["category"]: r for r in report.collect()}
    assert {k: r["reached"] for k, r in got.items()} == {"A": True, "b": True, "x": True, "y": True, "gone": False}
    drawn = sample.collect()
    assert len(drawn) == len({r["file_id"] for r in drawn}) == 120
    for c, f, share in (("A", 1, 0.3), ("b", 1, 0.7), ("x", 0, 0.5), ("y", 0, 0.5)):
        n = sum(r["cell"][f] == c.lower() for r in drawn)
        assert n == got[c]["drawn"] and abs(n / 120 - share) < 0.02
    files = spark.createDataFrame([], FILES)
    assert joint_sample(files, spark.createDataFrame(targets, TARGETS))[0].count() == 0
    assert joint_sample(files, spark.createDataFrame([], TARGETS))[1].count() == 0


def test_floors_of_others_take_seats(spark):
    """A category can have enough records and still not reach its share."""
    rows = [(f"f{i}", "a" if i < 85 else "b", None, "c", 1) for i in range(100)]
    report = proportional_sample(spark.createDataFrame(rows, FILES), spark.createDataFrame([("kind", "a", 0.5, 0, 0), ("kind", "b", 0.5, 15, 0)], TARGETS))[1]
    assert {r["category"]: (r["drawn"], r["enough"], r["reached"]) for r in report.collect()} == {"a": (5, True, False), "b": (15, True, True)}
