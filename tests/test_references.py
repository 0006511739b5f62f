import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sonarloom.operators.references import dangling_references, located
from sonarloom.operators.skew import hot_keys, skew_join

T0 = datetime(2024, 1, 1)
REFS = "target string, key string, own_time timestamp_ntz, file_id string, n long, run string"
PARENTS = "target string, key string, arrived timestamp_ntz"
REMOVED = "target string, key string, removed_at timestamp_ntz"


def brute(refs, parents, removed):
    out = []
    for target, key, own, *rest in refs:
        if key is None:
            continue
        times = [t for g, k, t in parents if (g, k) == (target, key)]
        gone = [t for g, k, t in removed if (g, k) == (target, key) and t]
        known = [t for t in times if t]
        if not times:
            reason = "missing"
        elif gone and known and max(gone) >= max(known):
            reason = "withdrawn"
        elif known and own and min(known) > own:
            reason = "late"
        else:
            continue
        out.append((target, key, own, *rest, reason))
    return sorted(out, key=str)


def run(spark, refs, parents, removed):
    found = dangling_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(removed, REMOVED))
    return sorted((tuple(r[c] for c in ("target", "key", "own_time", "file_id", "n", "run", "reason")) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    keys = [f"a/EN{n:05d}/EN{n:05d}_x{j}.wav" for n in (1, 2, 3, 9, 1023, 1024, 1025) for j in (1, 2)] + ["plain", "", "x\x01y12", "12", "012", "0", "99999999999999999999", None]

    def when():
        return None if rng.random() < 0.1 else T0 + timedelta(days=rng.randrange(6))

    def some(n):
        return [(rng.choice("tu"), rng.choice(keys), when()) for _ in range(n)]

    refs = [(*r, f"f{i % 7}", i, "clash") for i, r in enumerate(some(150))]
    parents, removed = some(40), some(12)
    assert run(spark, refs, parents, removed) == brute(refs, parents, removed)


def test_empty_tables(spark):
    ref = [("t", "k1", T0, "f", 1, "x")]
    assert run(spark, [], [("t", "k", T0)], []) == []
    assert [r[-1] for r in run(spark, ref, [], [])] == ["missing"]


def test_hot_key_is_matched_once(spark):
    refs = [("t", "k7", T0 + timedelta(days=i % 4), f"f{i}", i, "x") for i in range(400)]
    parents = [("t", "k7", T0 + timedelta(days=2))]
    assert run(spark, refs, parents, []) == brute(refs, parents, [])


def test_split_key_loses_nothing(spark):
    keys = ["a1b1", "a\x01b\x01", "a1b01", "\x02x", "x", "", "1", "01", "a12b1"]
    got = [(r["template"], r["n"]) for r in located(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert len(set(got)) == len(keys)


def test_hot_keys_are_spread(spark, monkeypatch):
    """Keys with half of the rows, dangling and sound, take the other way and give the same rows."""
    monkeypatch.setattr("sonarloom.operators.skew.LEAST", 20)
    refs = [("t", k, T0 + timedelta(days=i % 4), f"f{i}", i, "x") for k in ("gone", "k7", "fine", "old") for i in range(200)] + [("t", f"k{i}", T0, f"g{i}", i, "x") for i in range(40)]
    parents = [("t", "k7", T0 + timedelta(days=2)), ("t", "fine", T0), ("t", "old", T0), *[("t", f"k{i}", T0) for i in range(30) if i != 7]]
    removed = [("t", "old", T0 + timedelta(days=9)), ("t", "k3", T0 + timedelta(days=9))]
    assert run(spark, refs, parents, removed) == brute(refs, parents, removed)
    rows = spark.createDataFrame([(r[0], r[1], r[3]) for r in refs], "target string, key string, file_id string")
    hot = hot_keys(rows.groupBy("target", "key").agg(F.count("*").alias("n")), ["target", "key"])
    assert {r["key"]: r["parts"] for r in hot.collect()} == {"gone": 10, "k7": 11, "fine": 10, "old": 10}
    few = spark.createDataFrame([("t", "gone", 1), ("t", "gone", 2), ("t", "k1", 3), ("t", "none", 4)], "target string, key string, v int")
    got = skew_join(rows, few, hot, ["target", "key"], ["file_id"])
    assert sorted(map(tuple, got.select("key", "file_id", "v").collect())) == sorted((r[1], r[3], v) for r in refs for k, v in (("gone", 1), ("gone", 2), ("k1", 3)) if r[1] == k)
