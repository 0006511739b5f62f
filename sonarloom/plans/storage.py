"""Tables and signals written to files and read back, with SQL over what they were made from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.operators import history
from sonarloom.plans.base import ENVELOPES, SIGNALS, envelopes, registry, signals
from sonarloom.session import cut, shared_dir, table
from sonarloom.sources import audio
from sonarloom.sources.files import listing, suffix_paths
from sonarloom.sources.sinks import append_missing, read_envelopes, write_envelopes, write_twins

QUERIES, SQL, query = registry()
RATE = 8000
#: The signals as 24-bit files hold them.
_STORED = f"{SIGNALS.strip()}, q AS (SELECT vec_id, list_transform(x, lambda v: round_even(v * 8388608, 0) / 8388608) AS x FROM s)\n"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT s.layout, t.instrument_canonical, t.stem_group, t.pitched, t.n FROM (SELECT instrument_canonical, max(stem_group) AS stem_group, bool_or(pitched) AS pitched, count(*) AS n FROM taxonomy GROUP BY 1) t CROSS JOIN (SELECT unnest(['csv', 'parquet']) AS layout) s")
def twins_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as parquet and csv side by side, and both read back."""
    rows = table(spark, d, "taxonomy").groupBy("instrument_canonical").agg(F.max("stem_group").alias("stem_group"), F.bool_or("pitched").alias("pitched"), F.count("*").alias("n"))
    parquet, csv = write_twins(rows, f"{_folder(spark, 'twins')}/taxonomy", ["instrument_canonical"], paths=suffix_paths)
    back = spark.read.csv(csv, header=True, schema="instrument_canonical string, stem_group string, pitched boolean, n long")
    return spark.read.parquet(parquet).withColumn("layout", F.lit("parquet")).unionByName(back.withColumn("layout", F.lit("csv"))).select("layout", "instrument_canonical", "stem_group", "pitched", "n")


@query("SELECT o_orderkey, o_orderstatus <> 'F' AS cached FROM orders")
def append_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Appending to a table that holds some of the keys writes the others only, and tells them apart."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _folder(spark, "appended")
    append_missing(orders.filter("o_orderstatus <> 'F'"), path, ["o_orderkey"])
    told = append_missing(orders, path, ["o_orderkey"])
    # Each key is there once: a key that was written twice would come out twice.
    return told.join(spark.read.parquet(path).select("o_orderkey"), "o_orderkey")


@query(f"WITH {ENVELOPES} SELECT series AS path, block, round(db, 3) AS db FROM env WHERE block >= 5 AND block < 12")
def envelope_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of stored envelopes."""
    path, blocks = _folder(spark, "envelopes"), envelopes(spark, d).withColumnRenamed("series", "path")
    write_envelopes(blocks, path)
    ranges = blocks.select("path").distinct().select("path", F.lit(5).alias("first"), F.lit(7).alias("n"))
    return read_envelopes(spark, path, ranges).select("path", "block", F.round("db", 3).alias("db"))


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Every signal as a stereo file, its reverse on the right."""
    folder = _folder(spark, "wav")
    channels = F.array(F.col("x"), F.reverse("x"))
    files = signals(spark, d).select("vec_id", F.concat(F.lit(folder + "/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), channels.alias("x"), F.lit(RATE).alias("sr"))
    written = cut(audio.write(files), "written")
    return written.filter("error = ''").select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "path"), folder


@query(f"WITH {SIGNALS} SELECT vec_id, {RATE} AS sr, 'PCM_24' AS subtype, 2 AS channels, len(x)::BIGINT AS frames, round(len(x) / {RATE}.0::DOUBLE, 6) AS duration FROM s")
def wav_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header facts of the files that a listing finds."""
    _, folder = _stored(spark, d)
    heads = audio.headers(listing(spark, folder))
    return heads.filter("error = ''").select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "sr", "subtype", "channels", "frames", F.round("duration", 6).alias("duration"))


@query(f"WITH {SIGNALS}, b AS (SELECT vec_id, (u.b)::INT AS block, x[u.b * 8 + 1 : u.b * 8 + 8] AS l, list_reverse(x)[u.b * 8 + 1 : u.b * 8 + 8] AS r FROM s, unnest(range(len(x) // 8)) u(b)) SELECT vec_id, block, round(10 * log10(greatest(list_sum(list_transform(l, lambda v: v * v)), list_sum(list_transform(r, lambda v: v * v))) / 8), 1) AS db FROM b")
def wav_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Levels of blocks of eight values, the louder channel, streamed three blocks at a time."""
    files, _ = _stored(spark, d)
    return audio.envelope(files, 8 / RATE, blocks_per_read=3).join(files, "path").select("vec_id", "block", F.round(F.col("db").cast("double"), 1).alias("db"))


@query(f"WITH {_STORED} SELECT vec_id, (u.i)::INT AS pos, round(coalesce(x[60 + u.i + 1], 0), 6) AS left_x, round(coalesce(list_reverse(x)[60 + u.i + 1], 0), 6) AS right_x FROM q, unnest(range(10)) u(i)")
def wav_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Ten values from the sixtieth of every file; beyond its end they are 0."""
    files, _ = _stored(spark, d)
    got = audio.excerpts(files.select("path", F.lit(60).alias("start"), F.lit(10).alias("frames"))).filter("error = ''").join(files, "path")
    pairs = F.arrays_zip(F.get("x", F.lit(0)).alias("l"), F.get("x", F.lit(1)).alias("r"))
    return got.select("vec_id", F.posexplode(pairs).alias("pos", "v")).select("vec_id", "pos", *[(F.round(F.col(f"v.{c}").cast("double"), 6) + F.lit(0.0)).alias(n) for c, n in (("l", "left_x"), ("r", "right_x"))])


@query(f"""WITH {_STORED}, c AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS x, vec_id % 2 = 0 AS one FROM q), p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM c)
SELECT vec_id, CASE WHEN one THEN 1 ELSE 2 END AS out_channels, len(x)::BIGINT AS out_frames, round(peak, 6) AS peak_before, round(CASE WHEN peak > 0.3 THEN 0.25 ELSE peak END, 6) AS peak_after, peak > 0.3 AS peak_normalized,
  CASE WHEN one THEN 'pick_channel;' ELSE '' END || 'dc' || CASE WHEN peak > 0.3 THEN ';peak' ELSE '' END AS ops_applied, false AS cached FROM p""")
def wav_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The chain of one file: channel, offset, peak and write; every other signal keeps one channel."""
    files, folder = _stored(spark, d)
    tasks = files.select(F.col("path").alias("src_path"), F.concat(F.lit(folder + "/out/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("out_path"), F.when(F.col("vec_id") % 2 == 0, "pick_channel").otherwise("keep_stereo").alias("channel_action"))
    # Written once: a second run of the same tasks would find the files there.
    done = cut(audio.ingest(tasks, RATE, ceiling=0.3, peak=0.25), "ingested").join(files.withColumnRenamed("path", "src_path"), "src_path")
    return done.filter("error = ''").select("vec_id", "out_channels", "out_frames", "peak_before", "peak_after", "peak_normalized", "ops_applied", "cached")


@query("""
WITH m AS (SELECT dense_rank() OVER (ORDER BY scan_date) AS epoch, stem_group AS class, seg_p50_s AS v FROM activity_summary WHERE stem_group IS NOT NULL),
c AS (SELECT epoch, class, avg(v) AS m FROM m WHERE NOT isnan(v) AND v IS NOT NULL AND isfinite(v) GROUP BY ALL), e AS (SELECT epoch, avg(m) AS score FROM c GROUP BY epoch)
SELECT arg_max(epoch, score)::INT AS best_epoch, round(max(score), 4) AS best_score, max(epoch)::INT AS last_epoch FROM e""")
def evaluation_history(spark: SparkSession, d: str) -> DataFrame:
    """Nested metrics of every evaluation, named by number, to the best and the last one."""
    days = table(spark, d, "activity_summary").filter("stem_group is not null").select("scan_date", F.col("stem_group").alias("class"), F.when(F.abs("seg_p50_s") < float("inf"), F.col("seg_p50_s")).alias("v"))
    order = days.select("scan_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy().orderBy("scan_date")))  # a row per day
    lists = days.join(F.broadcast(order), "scan_date").groupBy("k", "class").agg(F.collect_list("v").alias("values"))
    nested = lists.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("class", "values"))).alias("by_class"))
    metrics = nested.select(F.create_map(F.concat(F.lit("epoch_"), F.col("k").cast("string")), F.create_map(F.lit("active"), F.col("by_class"))).alias("metrics"))
    best = history.best_epoch(history.trajectory(history.flatten(metrics), "active"))
    return best.select("best_epoch", F.round("best_score", 4).alias("best_score"), "last_epoch")
