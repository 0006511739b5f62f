"""Seeded splits, draws and plans of examples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.operators.matching import draw_targets, level_as_drawn, outcome, pool_pick, reference, stem_gain, window_offsets
from sonarloom.operators.sampling import drawn_segment, excerpt_start, matched_gain, stratified_split as split_by, uniform_md5, uniform_md5_sql, weighted_draw as draw_by
from sonarloom.operators import sequence as seq
from sonarloom.plans.base import category, category_sql, envelopes, registry
from sonarloom.plans.sequences import _SEGMENTS, BLOCK_S, RULES
from sonarloom.session import cut, table

QUERIES, SQL, query = registry()
RATE, WINDOW_S = 44100, 10.0

_SONGS = "songs AS (SELECT song_id, min(genre_sub) AS genre FROM stem_duplicate_scan WHERE song_id IS NOT NULL GROUP BY song_id)"


def _songs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stem_duplicate_scan").filter("song_id is not null").groupBy("song_id").agg(F.min("genre_sub").alias("genre"))


@query(f"""WITH {_SONGS}, r AS (SELECT *, count(*) OVER (PARTITION BY genre) AS n, row_number() OVER (PARTITION BY genre ORDER BY md5('42/' || song_id), song_id) AS r FROM songs),
q AS (SELECT *, greatest(0, least(greatest(1, round_even(n * 0.15::DOUBLE, 0)), n - 2)) AS t FROM r), z AS (SELECT *, greatest(0, least(greatest(1, round_even(n * 0.1::DOUBLE, 0)), n - t - 1)) AS v FROM q)
SELECT song_id, genre, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM z""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_by(_songs(spark, d), "genre", "song_id", 0.15, 0.1, 42)


_U = uniform_md5_sql("'7'", "event_id::VARCHAR", "'density'")


@query(f"SELECT event_id, CASE WHEN u < 0.1 THEN 1 WHEN u < 0.4 THEN 2 WHEN u < 0.8 THEN 3 ELSE 4 END::INT AS n_classes FROM (SELECT event_id, {_U} AS u FROM events)")
def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """A class count for each item, by a stated distribution."""
    density = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 4.0), (4, 2.0)], "n_classes int, weight double")
    draws = table(spark, d, "events").select("event_id", uniform_md5(F.lit("7"), F.col("event_id").cast("string"), F.lit("density")).alias("u"))
    return draw_by(draws, "u", density, "n_classes", "weight").select("event_id", "n_classes")


@query(f"WITH {_SONGS} SELECT genre, song_id FROM (SELECT genre, song_id, row_number() OVER (PARTITION BY genre ORDER BY md5('k/' || song_id), song_id) AS r FROM songs) WHERE r <= 3")
def k_of_n_draw(spark: SparkSession, d: str) -> DataFrame:
    """Three songs of each genre, without replacement."""
    w = Window.partitionBy("genre").orderBy(F.md5(F.concat_ws("/", F.lit("k"), "song_id")), "song_id")
    return _songs(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("genre", "song_id")


_S, _I, _K = (uniform_md5_sql("'e'", "series", f"'{x}'") for x in ("segment", "inside", "back"))


@query(f"""WITH {_SEGMENTS.strip()}, f AS (SELECT file_id AS series, max(out_frames) AS frames FROM source_manifest WHERE out_frames > 0 GROUP BY file_id),
c AS (SELECT series, a, b, sum(b - a) OVER (PARTITION BY series ORDER BY a) AS upto, {_S} * sum(b - a) OVER (PARTITION BY series) AS p FROM seg),
drawn AS (SELECT series, (a + {_I} * (b - a)) * {BLOCK_S}::DOUBLE AS anchor FROM c WHERE upto - (b - a) <= p AND p < upto)
SELECT series AS file_id, greatest(0, least(round_even((anchor - {_K} * {WINDOW_S}::DOUBLE) * {RATE}, 0)::BIGINT, greatest(0, frames - {int(RATE * WINDOW_S)}))) AS start_frame FROM drawn JOIN f USING (series)""")
def activity_excerpt_plan(spark: SparkSession, d: str) -> DataFrame:
    """Where each file's excerpt starts: a segment drawn by its length, an anchor in it, the window at random around the anchor.

    Files without an envelope, and silent ones, have no segment and no row.
    """
    f = table(spark, d, "source_manifest").filter("out_frames > 0").groupBy(F.col("file_id").alias("series")).agg(F.max("out_frames").alias("frames"))
    u = {x: uniform_md5(F.lit("e"), F.col("series"), F.lit(x)) for x in ("segment", "inside", "back")}
    one = drawn_segment(seq.segments(envelopes(spark, d), RULES), u["segment"]).join(f, "series")
    anchor = (F.col("start") + u["inside"] * (F.col("end") - F.col("start"))) * BLOCK_S
    return one.select(F.col("series").alias("file_id"), excerpt_start(anchor, u["back"], WINDOW_S, RATE, F.col("frames")).alias("start_frame"))


#: What stands in for measured loudness here: RMS levels of files, and mean power of scanned excerpts for windows.
#: Levels of one dataset's training windows are the reference; those of `matched` are moved towards it.
REFERENCE, MATCHED, EMPIRICAL, MEAN = "71955", ("71470",), 300, 100
GAIN_LOW, GAIN_HIGH, MONO_DB = 0.25, 1.25, 10 * math.log10(2)

_LEVELS_SQL = f"""files AS (SELECT file_id, arg_max(dataset, k) AS dataset, arg_max(class, k) AS class, arg_max(channels, k) AS channels, arg_max(frames, k) AS frames, max(db) AS db FROM (
    SELECT file_id, {category_sql('dataset')} AS dataset, {category_sql('stem_group')} AS class, out_channels AS channels, out_frames AS frames, CASE WHEN rms > 0 AND isfinite(rms) THEN 20 * log10(rms) END AS db,
      concat_ws('|', coalesce(ingested_at::VARCHAR, ''), {category_sql('dataset')}, {category_sql('stem_group')}, out_channels::VARCHAR, out_frames::VARCHAR) AS k FROM source_manifest WHERE {category_sql('stem_group')} IS NOT NULL) GROUP BY file_id),
scans AS (SELECT file_id, scanned_at, 10 * log10(list_avg(list_transform(excerpt_levels, lambda x: pow(10, x::DOUBLE / 10)))) AS db FROM stem_duplicate_scan WHERE carries_signal AND len(excerpt_levels) > 0 AND len(list_filter(excerpt_levels, lambda x: isfinite(x))) = len(excerpt_levels)),
windows AS (SELECT DISTINCT f.class, f.dataset, file_id AS source, round(s.db, 6) AS db, f.db AS file_db FROM scans s JOIN files f USING (file_id)),
own AS (SELECT * FROM windows WHERE dataset = '{REFERENCE}'),
tiers AS (SELECT c.class, CASE WHEN g.n >= {EMPIRICAL} THEN 'empirical' WHEN g.n >= {MEAN} THEN 'class_mean' ELSE 'pooled' END AS tier, round(CASE WHEN g.n >= {MEAN} THEN g.m ELSE p.m END, 4) AS mean_db, round(CASE WHEN g.n >= {EMPIRICAL} THEN g.s ELSE p.s END, 4) AS spread_db
  FROM (SELECT DISTINCT class FROM files) c LEFT JOIN (SELECT class, count(DISTINCT source) AS n, avg(db) AS m, stddev_pop(db) AS s FROM own GROUP BY class) g USING (class) CROSS JOIN (SELECT avg(db) AS m, stddev_pop(db) AS s FROM own) p),
offsets AS (SELECT g.dataset, g.class, coalesce(o.x, p.x, 0) AS offset_db FROM (SELECT DISTINCT dataset, class FROM files) g LEFT JOIN (SELECT dataset, class, avg(db - file_db) AS x FROM windows WHERE file_db IS NOT NULL GROUP BY ALL) o ON o.dataset = g.dataset AND o.class = g.class CROSS JOIN (SELECT avg(db - file_db) AS x FROM windows WHERE file_db IS NOT NULL) p),
pool AS (SELECT pool, db, row_number() OVER (PARTITION BY pool ORDER BY {uniform_md5_sql("'r'", 'pool', 'source', 'db::DECIMAL(18,6)::VARCHAR')}, source, db) AS place, count(*) OVER (PARTITION BY pool) AS size FROM (SELECT class AS pool, source, db FROM own UNION ALL SELECT '*', source, db FROM own))"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row per file with a class: dataset, class, channels and frames of its latest row, db: its level."""
    m = table(spark, d, "source_manifest").select("file_id", category("dataset").alias("dataset"), category("stem_group").alias("class"), F.col("out_channels").alias("channels"), F.col("out_frames").alias("frames"), F.when((F.col("rms") > 0) & (F.col("rms") < float("inf")), 20 * F.log10("rms")).alias("db"), "ingested_at").filter("class is not null")
    order = F.concat_ws("|", F.coalesce(F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")), "dataset", "class", F.col("channels").cast("string"), F.col("frames").cast("string"))
    return m.groupBy("file_id").agg(*[F.max_by(c, order).alias(c) for c in ("dataset", "class", "channels", "frames")], F.max("db").alias("db"))


def _windows(spark: SparkSession, d: str, files: DataFrame) -> DataFrame:
    """Levels of scanned excerpts: class, dataset, source, db, file_db. An excerpt with a level that is no number is left out."""
    levels = F.col("excerpt_levels")
    whole = table(spark, d, "stem_duplicate_scan").filter("carries_signal").filter((F.size(levels) > 0) & F.forall(levels, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    power = F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x.cast("double") / 10)) / F.size(levels)
    found = whole.select("file_id", F.round(10 * F.log10(power), 6).alias("window_db"))
    return found.join(files, "file_id").select("class", "dataset", F.col("file_id").alias("source"), F.col("window_db").alias("db"), F.col("db").alias("file_db")).distinct()


def _matching(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files = cut(_files(spark, d), "files")
    windows = cut(_windows(spark, d, files), "windows")
    own = windows.filter(F.col("dataset") == REFERENCE).select("class", "source", "db")
    tiers = reference(own, files.select("class").distinct(), EMPIRICAL, MEAN)
    offsets = window_offsets(windows.filter("file_db is not null").select("dataset", "class", (F.col("db") - F.col("file_db")).alias("off_db")), files.select("dataset", "class").distinct())
    return files, own, tiers, offsets


def _u(tag: str, *key) -> Column:
    return uniform_md5(F.lit("g"), *key, F.lit(tag))


def _us(tag: str, *key: str) -> str:
    return uniform_md5_sql("'g'", *key, f"'{tag}'")


def _required(spark: SparkSession, d: str, draws: DataFrame, own: DataFrame, tiers: DataFrame, offsets: DataFrame, key: list) -> DataFrame:
    """draws: class, dataset, channels, db and what `key` names. Adds required_db, from the level as drawn to the drawn target."""
    u = {f"u_{t}": _u(t, *key) for t in ("pick", "jitter", "a", "b")}
    by_text = uniform_md5(F.lit("r"), F.col("pool"), F.col("source"), F.col("db").cast("decimal(18,6)").cast("string"))
    aimed = draw_targets(draws.withColumnRenamed("db", "source_db").withColumns(u), tiers, own, ["source"], 0, 0.5, by_text)
    return aimed.join(offsets, ["dataset", "class"], "left").withColumn("required_db", F.col("target_db") - level_as_drawn(F.col("source_db"), F.col("channels"), F.col("offset_db"))).drop(*u)


_AIMED = f"""aimed AS (SELECT a.*, CASE WHEN t.tier = 'class_mean' THEN t.mean_db + t.spread_db * sqrt(-2 * ln(1 - u_a)) * cos(2 * pi() * u_b) ELSE q.db + (u_jitter * 2 - 1) * 0.5 END - (a.db + CASE WHEN channels = 1 THEN {MONO_DB!r} ELSE 0 END + o.offset_db) AS required_db
  FROM asked a JOIN tiers t USING (class) JOIN offsets o ON o.dataset = a.dataset AND o.class = a.class LEFT JOIN (SELECT DISTINCT pool, size FROM pool) z ON z.pool = CASE WHEN t.tier = 'empirical' THEN a.class ELSE '*' END AND t.tier <> 'class_mean' LEFT JOIN pool q ON q.pool = z.pool AND q.place = floor(u_pick * z.size) + 1)"""
_GAIN_SQL = "CASE WHEN db >= -70 THEN pow(10, greatest(-20, least(25, required_db)) / 20) END"
_ASKED_FILES = f"asked AS (SELECT *, {', '.join(_us(t, 'file_id') + f' AS u_{t}' for t in ('pick', 'jitter', 'a', 'b'))} FROM files)"


@query(f"WITH {_LEVELS_SQL}, {_ASKED_FILES}, {_AIMED} SELECT file_id, class, round({_GAIN_SQL}, 4) AS gain FROM aimed WHERE dataset IN ('71470')")
def matched_gains(spark: SparkSession, d: str) -> DataFrame:
    """Gain of each file of the matched pool to a target drawn from its class's reference; files that cannot be measured have none."""
    files, own, tiers, offsets = _matching(spark, d)
    aimed = _required(spark, d, files.filter(F.col("dataset").isin(*MATCHED)), own, tiers, offsets, [F.col("file_id")])
    return aimed.select("file_id", "class", F.round(matched_gain(F.col("required_db"), F.col("source_db")), 4).alias("gain"))


@query(f"""WITH {_LEVELS_SQL}, {_ASKED_FILES}, {_AIMED} SELECT class, outcome, count(*) AS n FROM (SELECT class, CASE WHEN NOT coalesce(db >= -70, false) THEN 'unmeasurable' WHEN required_db < -20 OR required_db > 25 THEN 'clamped' ELSE 'matched' END AS outcome FROM aimed WHERE dataset IN ('71470')) GROUP BY ALL""")
def gain_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each class could be matched, were clamped, or have no level."""
    files, own, tiers, offsets = _matching(spark, d)
    aimed = _required(spark, d, files.filter(F.col("dataset").isin(*MATCHED)), own, tiers, offsets, [F.col("file_id")])
    return aimed.groupBy("class", outcome(F.col("required_db"), F.col("source_db")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_LEVELS_SQL} SELECT dataset, class, round(offset_db, 4) AS offset_db FROM offsets")
def window_offset_table(spark: SparkSession, d: str) -> DataFrame:
    """How far drawn windows lie from their files' levels, per pool and class."""
    return _matching(spark, d)[3].withColumn("offset_db", F.round("offset_db", 4))


#: Items of the plan, and what a pick may be restricted to.
ITEMS = 400


@query(f"""WITH {_LEVELS_SQL}, {_SEGMENTS.strip()},
seen AS (SELECT file_id, dataset, class, channels, frames, db FROM files WHERE frames > 0 AND file_id IN (SELECT series FROM seg)),
dens AS (SELECT n, count(*) AS songs FROM (SELECT song_id, count(DISTINCT stem_class) AS n FROM stem_duplicate_scan WHERE stem_class IS NOT NULL AND song_id IS NOT NULL GROUP BY song_id) WHERE n >= 1 GROUP BY n),
dist AS (SELECT n, sum(songs) OVER (ORDER BY n) / sum(songs) OVER () AS upto, row_number() OVER (ORDER BY n) = count(*) OVER () AS last FROM dens),
items AS (SELECT item, {_us('density', 'item::VARCHAR')} AS u FROM (SELECT unnest(range({ITEMS}))::INT AS item)),
many AS (SELECT item, min(n) AS n FROM items JOIN dist ON u < upto OR last GROUP BY item),
slots AS (SELECT item, n, class, row_number() OVER (PARTITION BY item ORDER BY md5(concat_ws('/', 'c', item::VARCHAR, class)), class) AS slot FROM many CROSS JOIN (SELECT DISTINCT class FROM seen)),
sizes AS (SELECT class, count(*) AS size FROM seen GROUP BY class),
placed AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {uniform_md5_sql("'f'", 'file_id')}, file_id) AS place FROM seen),
got AS (SELECT s.item, s.slot, p.* FROM slots s JOIN sizes z USING (class) JOIN placed p ON p.class = s.class AND p.place = floor({_us('file', 's.item::VARCHAR', 's.class')} * z.size) + 1 WHERE s.slot <= s.n),
cum AS (SELECT item, class, a, b, frames, sum(b - a) OVER (PARTITION BY item, class ORDER BY a) AS upto, {_us('segment', 'item::VARCHAR', 'class')} * sum(b - a) OVER (PARTITION BY item, class) AS p FROM got JOIN seg ON seg.series = got.file_id),
cutat AS (SELECT item, class, greatest(0, least(round_even(((a + {_us('anchor', 'item::VARCHAR', 'class')} * (b - a)) * {BLOCK_S}::DOUBLE - {_us('back', 'item::VARCHAR', 'class')} * {WINDOW_S}::DOUBLE) * {RATE}, 0)::BIGINT, greatest(0, frames - {int(RATE * WINDOW_S)}))) AS start_frame FROM cum WHERE upto - (b - a) <= p AND p < upto),
asked AS (SELECT *, {', '.join(_us(t, 'item::VARCHAR', 'class') + f' AS u_{t}' for t in ('pick', 'jitter', 'a', 'b'))} FROM got), {_AIMED}
SELECT item, slot, class, file_id, start_frame, round(CASE WHEN dataset IN ('71470') THEN coalesce({_GAIN_SQL}, 1) ELSE 1 END * (0.25 + {_us('gain', 'item::VARCHAR', 'class')}), 4) AS gain, {_us('swap', 'item::VARCHAR', 'class')} < 0.5 AS swapped FROM aimed JOIN cutat USING (item, class)""")
def item_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_items(spark, d, ITEMS)


def plan_items(spark: SparkSession, d: str, items: int, datasets: tuple[str, ...] | None = None, matched: tuple[str, ...] = MATCHED, swap: float = 0.5) -> DataFrame:
    """The plan of training items, ready to render: item, slot, class, file_id, start_frame, gain, swapped.

    Each item draws its number of classes from the songs' density, its classes, a file of each class, a
    segment of the file by length, an anchor in it and the window around it; then a gain, to the reference's level
    for matched pools, times a uniform factor. datasets: the pools that may be drawn from, all if none is
    given. No matched pool: all stems take the uniform factor alone. Every draw hangs on its item and class only.
    """
    files, own, tiers, offsets = _matching(spark, d)
    segments = cut(seq.segments(envelopes(spark, d), RULES), "segments")
    seen = files.filter("frames > 0").join(segments.select(F.col("series").alias("file_id")).distinct(), "file_id", "left_semi")
    if datasets is not None:
        seen = seen.filter(F.col("dataset").isin(*datasets))
    seen = cut(seen, "pool")
    song = table(spark, d, "stem_duplicate_scan").filter("stem_class is not null and song_id is not null").groupBy("song_id").agg(F.count_distinct("stem_class").alias("n"))
    density = song.groupBy("n").agg(F.count("*").cast("double").alias("songs"))
    many = draw_by(spark.range(items).select(F.col("id").cast("int").alias("item")).withColumn("u", _u("density", F.col("item").cast("string"))), "u", density, "n", "songs")
    # Items by classes: both are stated, a class list and a dataset length.
    slots = many.join(F.broadcast(seen.select("class").distinct()))
    by_item = Window.partitionBy("item").orderBy(F.md5(F.concat_ws("/", F.lit("c"), F.col("item").cast("string"), "class")), "class")
    chosen = slots.withColumn("slot", F.row_number().over(by_item)).filter("slot <= n")
    key = [F.col("item").cast("string"), F.col("class")]
    got = cut(pool_pick(chosen.withColumn("u_file", _u("file", *key)), seen, "class", ["file_id"], 0, "u_file", ["file_id", "dataset", "channels", "frames", "db"], uniform_md5(F.lit("f"), F.col("file_id"))), "picked")
    pieces = got.select("item", "class", "file_id", "frames").join(segments.withColumnRenamed("series", "file_id"), "file_id").withColumn("series", F.struct("item", "class"))
    one = drawn_segment(pieces, _u("segment", *key))
    anchor = (F.col("start") + _u("anchor", *key) * (F.col("end") - F.col("start"))) * BLOCK_S
    start = one.select("item", "class", excerpt_start(anchor, _u("back", *key), WINDOW_S, RATE, F.col("frames")).alias("start_frame"))
    aimed = _required(spark, d, got.select("item", "slot", "class", "dataset", "file_id", "channels", "db"), own, tiers, offsets, key)
    gain = stem_gain(F.col("required_db"), F.col("source_db"), F.col("dataset").isin(*matched) if matched else F.lit(False), _u("gain", *key), GAIN_LOW, GAIN_HIGH)
    return aimed.join(start, ["item", "class"]).select("item", "slot", "class", "file_id", "start_frame", F.round(gain, 4).alias("gain"), (_u("swap", *key) < swap).alias("swapped"))
