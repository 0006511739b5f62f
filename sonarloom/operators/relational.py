"""Row rules and joins with guarantees: derived keys, channel rule, fences, deduplication, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.text import nfc
from sonarloom.operators.aggregate import exact_percentiles


# Correlations from which two channels count as one, alike or opposite.
DUAL_MONO, ANTI_PHASE = 0.9999, -0.5


def channel_action(channels: Column, lr_corr: Column, lr_identical: Column, dual: float = DUAL_MONO, anti: float = ANTI_PHASE) -> Column:
    """keep_mono, pick_channel (both channels alike or opposite) or keep_stereo. A null or NaN correlation counts as 0."""
    corr = F.coalesce(F.when(F.abs(lr_corr) < float("inf"), lr_corr), F.lit(0.0))
    alike = F.coalesce(lr_identical, F.lit(False)) | (corr >= dual)
    return F.when(channels == 1, "keep_mono").when(alike | (corr <= anti), "pick_channel").otherwise("keep_stereo")


def file_id(dataset: Column, path: Column) -> Column:
    """dataset ':' path without its first two parts; of shorter paths the last part only."""
    parts = F.split(nfc(path), "/")
    return F.concat(dataset, F.lit(":"), F.when(F.size(parts) <= 2, F.element_at(parts, -1)).otherwise(F.array_join(F.slice(parts, 3, F.size(parts)), "/")))


def short_name(name: Column, prefix: Column) -> Column:
    """What follows the prefix, or else the last part between underscores."""
    return F.when(F.startswith(name, prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(F.element_at(F.split(name, "_"), -1))


def output_path(by_song: Column, root: Column, song: Column, source: Column) -> Column:
    """root/song/name where files are kept by song, else root/name."""
    name = F.element_at(F.split(source, "/"), -1)
    return F.when(by_song, F.concat_ws("/", root, song, name)).otherwise(F.concat_ws("/", root, name))


def iqr_fence(df: DataFrame, group: list[str], value: str, times: float) -> DataFrame:
    """Upper fence per group: p75 + times x (p75 - p25), exact."""
    p = exact_percentiles(df, group, F.col(value), {"_q1": 0.25, "_q3": 0.75})
    return p.select(*group, (F.col("_q3") + times * (F.col("_q3") - F.col("_q1"))).alias("fence"))


def dedupe_latest(df: DataFrame, key: list[str], newest: list[str], oldest: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by `newest`, or the least by `oldest`; ties by all other columns.

    An aggregate with map-side combine, so a key that many rows repeat does not make one big task.
    """
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in (oldest or newest)], *[F.col(c) for c in rest if c not in (oldest or newest)])
    picked = (F.min if oldest else F.max)(row).alias("_row")
    return df.groupBy(*key).agg(picked).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that must find exactly one partner for each row; a repeated or missing key raises when run."""
    once = right.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in right.columns if c not in on])).alias("_r"))
    joined = left.join(once, on, "left")
    checked = F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("not one partner for "), F.to_json(F.struct(*on)))).cast("long"))
    return joined.withColumn("_n", checked).filter(F.col("_n") == 1).select(*left.columns, "_r.*")


def lookup_strict(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join to a dimension that raises, when run, on a key it lacks."""
    marked = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    hit = F.coalesce("_hit", F.raise_error(F.concat(F.lit("no entry for "), F.to_json(F.struct(*on)))).cast("boolean"))
    return marked.filter(hit).drop("_hit")


def lookup_default(left: DataFrame, right: DataFrame, on: list[str], column: str, default: Column) -> DataFrame:
    """Left join to one column of a dimension; rows without an entry, or with a null one, get the default. A repeated key takes its greatest value."""
    once = right.groupBy(*on).agg(F.max(column).alias(column))
    return left.join(once, on, "left").withColumn(column, F.coalesce(F.col(column), default))


def with_files(keys: DataFrame, files: DataFrame, key: str, name: Column) -> DataFrame:
    """The keys for which the listing (column path) holds a file of that name: existence, not a join that repeats rows."""
    there = files.select(name.alias(key)).distinct()
    return keys.join(there, key, "left_semi")


def in_order_of(rows: DataFrame, order: DataFrame, on: list[str], position: str) -> DataFrame:
    """Rows put back in the order of another table, by its column `position`; rows it lacks come last, by key."""
    return rows.join(order.select(*on, position), on, "left").orderBy(F.asc_nulls_last(position), *on)


def slotted(rows: DataFrame, column: str, slots: list[str], trained: list[str] | None = None) -> DataFrame:
    """Adds slot: the place of the column's value in a stated list, which must equal the list trained with, in order. Other values have none."""
    if trained is not None and list(trained) != list(slots):
        raise ValueError(f"slots {slots} are not those of training, {trained}")
    places = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(slots)], f"{column} string, slot int")
    return rows.join(F.broadcast(places), column, "left")


def complete_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key with its value; a key without a value, or with two, raises when run."""
    once = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_z"))
    good = F.when((F.col(value) == F.col("_z")), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not one value for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(once.schema[value].dataType))
    return once.select(key, good.alias(value))
