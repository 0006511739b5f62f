"""Splits that keep related records together: components by random-mate contraction, cut by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.text import compared
from sonarloom.operators.prefix import running_sum
from sonarloom.operators.sampling import uniform_md5
from sonarloom.session import cut


def components(edges: DataFrame, seed: int = 1) -> DataFrame:
    """vertex, root for every vertex with an edge (a, b) to another. Isolated vertices are their own roots, unlisted.

    Each round a hash tosses a coin per vertex; every tail with a head beside it moves onto the least
    such head, and edges follow until none is left. Then labels are unwound from the last round to the first.
    Loops, repeated edges and null ends are ignored. Edges are deduplicated each round, so a
    vertex many records share weighs as much as its distinct neighbours only.
    """
    def tidy(found: DataFrame) -> DataFrame:
        return cut(found.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    edges, rounds = tidy(edges.select("a", "b")), []
    while edges.head(1):
        def head(v: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), F.lit(len(rounds)), v), F.lit(2)) == 1

        moves = edges.filter(head("a") != head("b")).select(F.when(head("a"), F.col("b")).otherwise(F.col("a")).alias("vertex"), F.when(head("a"), F.col("a")).otherwise(F.col("b")).alias("to"))
        mates = cut(moves.groupBy("vertex").agg(F.min("to").alias("to")), "mates")
        rounds.append(mates)
        on_a, on_b = mates.select(F.col("vertex").alias("a"), F.col("to").alias("ta")), mates.select(F.col("vertex").alias("b"), F.col("to").alias("tb"))
        edges = tidy(edges.join(on_a, "a", "left").join(on_b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")))
    if not rounds:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    labels = rounds[-1].select("vertex", F.col("to").alias("root"))
    for k, mates in enumerate(reversed(rounds[:-1])):
        later = labels.select(F.col("vertex").alias("to"), "root")
        labels = labels.unionByName(mates.join(later, "to", "left").select("vertex", F.coalesce("root", "to").alias("root")))
        if k % 4 == 3:
            labels = cut(labels, "labels")
    return labels


def folder(file_id: Column) -> Column:
    """The folder in `<dataset>:<folder>/<file>`; null where there is none."""
    return F.nullif(F.regexp_extract(file_id, r"^[^:]*:(.*)/[^/]*$", 1), F.lit(""))


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Distinct file_id, song (song_id, or else the folder in file_id), folder, split; songs and splits in lower case.

    A row with neither song nor folder stands for itself: its song is its file_id. Blank splits are null.
    """
    base = manifest.select(compared(F.col("file_id")).alias("file_id"), F.lower(compared(F.col("song_id"))).alias("song_id"), F.nullif(F.lower(compared(F.col("split"))), F.lit("")).alias("split"))
    place = F.lower(folder(F.col("file_id")))
    return base.withColumn("folder", place).select("file_id", F.coalesce("song_id", "folder", F.lower("file_id")).alias("song"), "folder", "split").filter(F.col("song").isNotNull()).distinct()


def assign_splits(rows: DataFrame, targets: DataFrame, seed: int = 1, giant: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(songs, components): every song's component and new split, and each component's weight.

    rows: as manifest_rows gives. Songs are joined by a common file_id and by song and folder of one
    row. songs: song, component (its least song), new_split. components: component, weight (distinct files), new_split.
    Components, in random order, take the stretches of the total weight that the targets cut; a component
    goes where its middle falls. Those over `giant` of the weight come first, the heaviest at the head of
    the largest share, where the many small ones after them can still even out the shares. A null file_id joins nothing.
    The order is by md5 of the component's name: any engine can redraw it.
    """
    rows = rows.select("file_id", "song", "folder")
    named = rows.filter(F.col("file_id").isNotNull())
    # One pass: the file's first song, which it counts for, and its last one.
    files = cut(named.groupBy("file_id").agg(F.min("song").alias("song"), F.max("song").alias("z")), "firsts")
    by_file = named.join(files.filter(F.col("song") != F.col("z")).select("file_id", F.col("song").alias("a")), "file_id").select("a", F.col("song").alias("b"))
    by_folder = rows.filter(F.col("folder") != F.col("song")).select(F.col("song").alias("a"), F.col("folder").alias("b"))
    labels = cut(components(by_file.unionByName(by_folder), seed), "components")
    by_song = files.groupBy("song").agg(F.count("*").alias("files"))
    vertices = rows.select("song").distinct().join(by_song, "song", "left").join(labels.withColumnRenamed("vertex", "song"), "song", "left")
    songs = cut(vertices.select("song", F.coalesce("root", "song").alias("root"), F.coalesce("files", F.lit(0)).alias("files")), "songs")
    weights = cut(songs.groupBy("root").agg(F.min("song").alias("component"), F.sum("files").alias("weight")), "weights")
    total, n = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).head()
    u = uniform_md5(F.lit(str(seed)), F.col("component"))
    ordered = weights.withColumn("_u", F.when(F.col("weight") > giant * total, 1e-6 * (1 - F.col("weight") / (total + 1))).otherwise(1e-6 + u * (1 - 1e-6)))
    placed = running_sum(ordered, [], "_u", ["component"], F.col("weight"), "_before", rows=n)
    cuts, upto = [], 0.0
    for r in targets.select("split", "target_share").orderBy(F.desc("target_share"), "split").collect():
        upto += r["target_share"]
        cuts.append((r["split"], upto))
    middle = (F.col("_before") + F.col("weight") / 2) / F.lit(float(max(total, 1)))
    new = F.lit(cuts[-1][0]) if cuts else F.lit(None).cast("string")
    for name, at in reversed(cuts[:-1]):
        new = F.when(middle < at, name).otherwise(new)
    found = cut(placed.select("root", "component", "weight", new.alias("new_split")), "component-splits")
    return songs.select("song", "root").join(found.select("root", "component", "new_split"), "root").drop("root"), found.drop("root")


def straddling(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Songs whose rows have two different splits or more today: song, splits.

    Each song and each of its splits is a vertex, and every distinct (song, split) an edge; the
    contracted components are the songs, and those that hold several splits straddle. Null splits join nothing.
    """
    mark = "\x01"
    today = rows.filter(F.col("split").isNotNull()).select("song", "split").distinct()
    edges = today.select(F.concat("song", F.lit(mark)).alias("a"), F.concat("song", F.lit(mark), "split").alias("b"))
    held = components(edges, seed)
    # Roots are listed as no vertex: each stands for itself.
    every = held.unionByName(held.select(F.col("root").alias("vertex"), "root").distinct())
    song, split = F.regexp_extract("vertex", f"(?s)^(.*){mark}", 1), F.nullif(F.regexp_extract("vertex", f"(?s){mark}([^{mark}]*)$", 1), F.lit(""))
    return every.groupBy("root").agg(F.max(song).alias("song"), F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1).select("song", "splits")
