"""Excerpts that occur, the same or nearly so, under an evaluation split and the training split.

Two excerpts are near if, for some constant g, at least NEED of their LEVELS block levels satisfy
|a - b - g| <= TOLERANCE: their aligned level sets have a Jaccard similarity of at least
NEED / (2*LEVELS - NEED).

Shingles are the level steps within a band of positions, and do not change with g. Minwise hashes
keep a random part of the shingles, so that a pair at the threshold is missed now and then; here
every pair must come out, so the bands are fixed instead: with at most LEVELS - NEED bad
positions, one of LEVELS - NEED + 1 disjoint bands is clean in every near pair. Its steps then
differ by at most 2*TOLERANCE, so the bucket of its leading steps is one of the few that the evaluation
side probes. Only cross-split candidates meet, and each is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.text import compared
from sonarloom.operators.skew import for_parts, hot_keys, in_parts, skew_join
from sonarloom.session import cut

LEVELS, NEED, TOLERANCE = 24, 20, 0.5
#: The most a clean step can differ, with room for rounding, and the width of a bucket: two cover that.
REACH = 2 * TOLERANCE + 0.002
WIDTH = 2 * REACH + 0.005
BANDS = [tuple(int(x) for x in b) for b in np.array_split(np.arange(LEVELS), LEVELS - NEED + 1)]
#: Leading steps that make the bucket of a band.
LEADING = 2
#: Cells of a step: those beyond share the outermost. So there are at most len(BANDS) * CELLS ** LEADING buckets, 327,680.
CELLS = 256
#: Candidates verified at a time; excerpts of one side of a bucket that one task takes; rows a task.
_CHUNK, HOT, ROWS = 1 << 20, 20_000, 250_000


def scan_rows(scan: DataFrame) -> DataFrame:
    """Rows that can take part: file_id, side (eval or train), split, genre, md5 and levels in compared form.

    Rows without signal, with another split or a null file are out. Levels of another length are as
    missing; null, NaN and infinite levels are positions that never agree.
    """
    split = F.lower(compared(F.col("split")))
    levels = F.transform(F.col("excerpt_levels"), lambda x: F.when(F.abs(x) < float("inf"), x.cast("float")))
    return (
        scan.filter(F.col("carries_signal") & F.col("file_id").isNotNull())
        .select(
            compared(F.col("file_id")).alias("file_id"), split.alias("split"), compared(F.col("genre_sub")).alias("genre"),
            F.nullif(F.lower(compared(F.col("excerpt_md5"))), F.lit("")).alias("md5"), F.when(F.size("excerpt_levels") == LEVELS, levels).alias("levels"),
        )
        .filter(F.col("split").isin("train", "val", "test"))
        .withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))
        .filter(F.col("md5").isNotNull() | F.col("levels").isNotNull())
    )


def _buckets(levels: Column, evaluated: Column) -> Column:
    """The buckets of a level vector: one for each clean band for train, every probe for eval."""

    def keys(shifts: list[tuple[int, ...]]) -> Column:
        found = []
        for b, band in enumerate(BANDS):
            at = [levels[p].cast("double") for p in band]
            clean = at[0].isNotNull()
            for x in at[1:]:
                clean = clean & x.isNotNull()
            for shift in shifts:
                key = F.lit(b).cast("long")
                for j, s in enumerate(shift):
                    cell = F.floor((at[j + 1] - at[j] + s * REACH) / WIDTH)
                    key = key * CELLS + F.greatest(F.lit(0).cast("long"), F.least(F.lit(CELLS - 1).cast("long"), cell + CELLS // 2))
                found.append(F.when(clean, key))
        # Both probes of a step can fall into one bucket: it is kept once.
        return F.array_compact(F.array_distinct(F.array(*found)))

    return F.when(evaluated, keys(list(product((-1, 1), repeat=LEADING)))).otherwise(keys([(0,) * LEADING]))


def near(difference: np.ndarray) -> np.ndarray:
    """Of the rows a - b, those that some constant g brings within TOLERANCE at NEED positions or more."""
    ordered = np.sort(difference, axis=1)  # NaN last: never inside a finite span
    with np.errstate(invalid="ignore"):
        return (ordered[:, NEED - 1 :] - ordered[:, : LEVELS - NEED + 1] <= 2 * TOLERANCE + 1e-9).any(1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets -> near pairs of classes (eval, train)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    bucket, ids, evaluated = rows["bucket"].to_numpy(), rows["class"].to_numpy(), rows["evaluated"].to_numpy()
    levels = rows["levels"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, LEVELS)
    most = max(map(len, BANDS))
    positions = np.array([[*band, *[band[-1]] * (most - len(band))] for band in BANDS])
    own = np.take_along_axis(levels, positions[bucket // CELLS**LEADING], axis=1)
    steps = np.diff(own, axis=1)
    middle = steps[:, LEADING]
    short = np.array([len(band) < most for band in BANDS])[bucket // CELLS**LEADING]
    last = np.where(short, middle, steps[:, -1])
    own = np.ascontiguousarray(own.T)
    # Within a bucket, training rows lie by the cell of the middle step, then by the last step:
    # the partners of an evaluation row are one stretch for each of the two cells it may find them in.
    _, place = np.unique(np.stack([bucket, rows["salt"].to_numpy()], 1), axis=0, return_inverse=True)
    place = place.ravel()

    def cell(shift: float) -> np.ndarray:
        return np.where(short, 0, np.clip(np.floor((middle + shift) / WIDTH) + 128, 0, 255)).astype(np.int64)

    def along(where: np.ndarray, cells: np.ndarray, by: float = 0.0) -> np.ndarray:
        return (place[where] * 256 + cells[where]) * 4096.0 + np.clip(last[where] + by, -1000, 1000) + 2048

    train, asked = np.flatnonzero(~evaluated), np.flatnonzero(evaluated)
    at = along(train, cell(0))
    order = np.argsort(at, kind="stable")
    train, at = train[order], at[order]
    below, above = cell(-REACH), cell(REACH)
    slack = 1e-3
    for cells, probing in ((below, asked), (above, asked[below[asked] != above[asked]])):
        low = np.searchsorted(at, along(probing, cells, -2 * TOLERANCE) - slack)
        count = np.maximum(np.searchsorted(at, along(probing, cells, 2 * TOLERANCE) + slack, side="right") - low, 0)
        ends = np.cumsum(count)
        i = 0
        while i < len(probing):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHUNK, side="right")))
            n = count[i:j]
            a, t = np.repeat(probing[i:j], n), train[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[i:j], n)]
            i = j
            # Position by position, as most pairs leave the band's span early.
            most_off = least_off = own[0][a] - own[0][t]
            for level in own[1:]:
                off = level[a] - level[t]
                most_off, least_off = np.maximum(most_off, off), np.minimum(least_off, off)
                keep = np.flatnonzero(most_off - least_off <= 2 * TOLERANCE + slack)
                a, t, most_off, least_off = a[keep], t[keep], most_off[keep], least_off[keep]
            # All clean positions lie within one span with the band's: of the rest, this drops nearly all again.
            all_off = levels[a] - levels[t]
            with np.errstate(invalid="ignore"):
                inside = (all_off >= most_off[:, None] - (2 * TOLERANCE + slack)) & (all_off <= least_off[:, None] + (2 * TOLERANCE + slack))
            keep = np.flatnonzero(inside.sum(1) >= NEED)
            keep = keep[near(levels[a[keep]].astype(np.float64) - levels[t[keep]])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]], pa.int64()), pa.array(ids[t[keep]], pa.int64())], names=["a", "b"])


def near_classes(classes: DataFrame) -> DataFrame:
    """Near pairs (a: eval class, b: train class) of distinct level vectors. classes: class, side, levels.

    A bucket that many excerpts share, on either side, is cut into parts of HOT rows of a side; every
    part of the one side meets every part of the other, so no task holds more than two of them.
    """
    sided = classes.select("class", (F.col("side") == "eval").alias("evaluated"), "levels")
    shingled = sided.withColumn("bucket", F.explode(_buckets(F.col("levels"), F.col("evaluated"))))
    counts = cut(shingled.groupBy("bucket").agg(F.count_if(~F.col("evaluated")).alias("trains"), F.count_if("evaluated").alias("evals")), "buckets")
    parts = counts.select("bucket", F.ceil(F.col("trains") / HOT).cast("int").alias("pt"), F.ceil(F.col("evals") / HOT).cast("int").alias("pe"))
    rows = counts.join(parts, "bucket").agg(F.coalesce(F.sum(F.col("trains") * F.col("pe") + F.col("evals") * F.col("pt")), F.lit(0))).head()[0]
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    own, other = F.when(F.col("evaluated"), F.col("pe")).otherwise(F.col("pt")), F.when(F.col("evaluated"), F.col("pt")).otherwise(F.col("pe"))
    # A bucket that one side lacks leaves here.
    placed = shingled.join(F.broadcast(parts.filter("pt > 0 and pe > 0")), "bucket").withColumn("_own", F.pmod(F.xxhash64("class"), own).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1)))
    salt = F.when(F.col("evaluated"), F.col("_other") * F.col("pe") + F.col("_own")).otherwise(F.col("_own") * F.col("pe") + F.col("_other"))
    spread = placed.select("bucket", "class", "evaluated", "levels", salt.alias("salt"))
    return spread.repartition(tasks, "bucket", "salt").mapInArrow(_verified, "a long, b long").distinct()


def cross_split_overlaps(scan: DataFrame) -> DataFrame:
    """Confirmed pairs: file_id_a < file_id_b, eval_file, train_file, split, genre (of the evaluation file), same.

    same: the digests are equal; else the excerpts are near. One row per pair and (split, genre) in
    which its evaluation file was scanned. A file is never paired with itself. Files with equal
    excerpts form a class: buckets and verification see one of each class, and only confirmed
    links are expanded, copies without number over parts. Null digests equal nothing. An empty scan gives no pairs.
    """
    rows = cut(scan_rows(scan), "scan-rows")
    vectors = rows.filter(F.col("levels").isNotNull()).groupBy("side", "levels").agg(F.min(F.xxhash64("side", "levels")).alias("class"))
    linked = near_classes(vectors)
    # m stands for the digest where only its crowd matters.
    keyed = rows.withColumn("class", F.when(F.col("levels").isNotNull(), F.xxhash64("side", "levels"))).withColumn("m", F.when(F.col("md5").isNotNull(), F.xxhash64("md5"))).drop("levels")
    hot = cut(hot_keys(cut(keyed.select(F.explode(F.array_compact(F.array("m", "class"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")), "copies"), ["k"]), "hot-copies")
    evals = keyed.filter(F.col("side") == "eval").select(F.col("file_id").alias("eval_file"), "split", "genre", "md5", "m", F.col("class").alias("a")).distinct()
    trains = keyed.filter(F.col("side") == "train").select(F.col("file_id").alias("train_file"), "md5", "m", F.col("class").alias("b")).distinct()

    def named(k: str) -> DataFrame:
        return hot.withColumnRenamed("k", k)

    def joined(left: DataFrame, right: DataFrame, key: str, on: list[str]) -> DataFrame:
        return for_parts(left, named(key), [key]).join(in_parts(right, named(key), [key], ["train_file"]).drop(*[c for c in right.columns if c in left.columns and c not in on]), [*on, "_part"])

    same = joined(evals.filter(F.col("md5").isNotNull()), trains.filter(F.col("md5").isNotNull()), "m", ["md5"]).select("eval_file", "train_file", "split", "genre", F.lit(True).alias("same"))
    one = skew_join(evals.select("eval_file", "split", "genre", "a").filter(F.col("a").isNotNull()), linked, named("a"), ["a"], ["eval_file"])
    close = joined(one, trains.select("train_file", "b").filter(F.col("b").isNotNull()), "b", ["b"]).select("eval_file", "train_file", "split", "genre", F.lit(False).alias("same"))
    least, most = F.least("eval_file", "train_file"), F.greatest("eval_file", "train_file")
    return (
        same.unionByName(close).filter(F.col("eval_file") != F.col("train_file"))
        .groupBy("eval_file", "train_file", "split", "genre").agg(F.max("same").alias("same"))
        .select(least.alias("file_id_a"), most.alias("file_id_b"), "eval_file", "train_file", "split", "genre", "same")
    )
