import random

from pyspark.sql import functions as F

from sonarloom.llm import splits
from sonarloom.llm.splits import assign_splits, components, manifest_rows, straddling

MANIFEST = "file_id string, song_id string, split string, song string, component string"
TARGETS = "split string, target_share double"


def roots(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for v in list(parent):
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_components(spark):
    rng = random.Random(2)
    names = [f"v{i}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [("hub", f"leaf{i}") for i in range(40)] + [(f"p{i}", f"p{i + 1}") for i in range(30)] + [(None, "v1"), ("v2", None), ("v3", "v3")]
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], {r["root"]}).add(r["vertex"])
    assert sorted(map(sorted, groups.values())) == roots(edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_assignment(spark):
    rows = [(f"D:s{i % 40}/f{i}", f"S{i % 40}" if i % 3 else None, ["train", " Val", "", None][i % 4], "x", "y") for i in range(400)]
    rows += [("D:s1/f1", "s2", "test", "x", "y"), (None, "s5", "train", "x", "y"), (None, "s6", "train", "x", "y"), ("nofolder", None, "train", "x", "y"), (None, None, "val", "x", "y")]
    rows += [(f"D:hot/f{i}", "hot", "train", "x", "y") for i in range(200)]
    manifest = manifest_rows(spark.createDataFrame(rows, MANIFEST)).cache()
    songs, found = assign_splits(manifest, spark.createDataFrame([("train", 0.75), ("val", 0.1), ("test", 0.15)], TARGETS))
    by_song = {r["song"]: (r["component"], r["new_split"]) for r in songs.collect()}
    assert by_song["s1"] == by_song["s2"] and by_song["s5"][0] != by_song["s6"][0] and "nofolder" in by_song
    placed = manifest.join(songs, "song").groupBy("component").agg(F.count_distinct("new_split").alias("n"))
    assert placed.filter("n > 1").count() == 0
    weight = {r[0]: r[1] for r in found.groupBy("new_split").agg(F.sum("weight")).collect()}
    assert sum(weight.values()) == 601 and abs(weight["train"] / 601 - 0.75) < 0.05
    want = {}
    for f, s, split, *_ in rows:
        song = (s or (f.split(":")[1].rpartition("/")[0] if f and "/" in f else f) or "").lower()
        if split and split.strip():
            want.setdefault(song, set()).add(split.strip().lower())
    want.pop("", None)
    assert {r["song"]: set(r["splits"]) for r in straddling(manifest).collect()} == {k: v for k, v in want.items() if len(v) > 1}


def test_empty(spark):
    manifest = manifest_rows(spark.createDataFrame([], MANIFEST))
    songs, found = assign_splits(manifest, spark.createDataFrame([("train", 1.0)], TARGETS))
    assert songs.count() == found.count() == straddling(manifest).count() == 0


def test_straddling_hangs_on_the_contraction(spark, monkeypatch):
    """A contraction that loses a move, or joins what has no edge, shows in the songs that are found."""
    rows = manifest_rows(spark.createDataFrame([(f"D:s{i % 9}/f{i}", f"s{i % 9}", ["train", "val"][i % 2] if i % 9 < 4 else "train", "x", "y") for i in range(90)], MANIFEST)).cache()
    assert {r["song"] for r in straddling(rows).collect()} == {"s0", "s1", "s2", "s3"}
    right = splits.components
    monkeypatch.setattr(splits, "components", lambda e, seed: right(e, seed).filter("vertex not like 's1%'"))
    assert {r["song"] for r in straddling(rows).collect()} != {"s0", "s1", "s2", "s3"}
    monkeypatch.setattr(splits, "components", lambda e, seed: right(e, seed).withColumn("root", F.lit("s8\x01")))
    assert {r["song"] for r in straddling(rows).collect()} != {"s0", "s1", "s2", "s3"}
