"""Scans, projections, filters, joins, set operations and rankings over the manifest tables."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarloom.functions.text import compared, compared_sql
from sonarloom.operators import sequence as seq
from sonarloom.operators.relational import (
    channel_action, complete_map, dedupe_latest, file_id, in_order_of, iqr_fence, join_one_to_one, lookup_default, lookup_strict, output_path, short_name, slotted,
)
from sonarloom.plans.base import MANIFEST, SIGNALS, category, category_sql, envelopes, manifest, registry, signals
from sonarloom.plans.sequences import _SEGMENTS, RULES
from sonarloom.session import shared_dir, table
from sonarloom.sources.files import csv_scan, union_scan

QUERIES, SQL, query = registry()
_M = f"WITH {MANIFEST} "


# Scans, projections and filters.


@query("SELECT file_id, role, out_frames FROM source_manifest WHERE role IN ('stem', 'clip') AND out_sr = 44100 AND out_channels = 1")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter(F.col("role").isin("stem", "clip") & (F.col("out_sr") == 44100) & (F.col("out_channels") == 1)).select("file_id", "role", "out_frames")


@query("SELECT instrument_canonical, coalesce(stem_group, '(held aside)') AS stem_class, count(*) AS n FROM source_manifest WHERE instrument_canonical IS NOT NULL GROUP BY ALL")
def null_label_coalesce(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "source_manifest").filter(F.col("instrument_canonical").isNotNull())
    return m.groupBy("instrument_canonical", F.coalesce("stem_group", F.lit("(held aside)")).alias("stem_class")).agg(F.count("*").alias("n"))


@query("""
SELECT path, CASE WHEN channels = 1 THEN 'keep_mono' WHEN lr_identical OR c >= 0.9999 THEN 'pick_channel' WHEN c <= -0.5 THEN 'pick_channel' ELSE 'keep_stereo' END AS action
FROM (SELECT *, coalesce(CASE WHEN isfinite(lr_corr) THEN lr_corr END, 0.0) AS c FROM audio_qc WHERE channels IS NOT NULL)""")
def channel_rule_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_qc").filter("channels is not null").select("path", channel_action(F.col("channels"), F.col("lr_corr"), F.col("lr_identical")).alias("action"))


@query(f"""
SELECT DISTINCT out_path, {compared_sql("dataset")} || ':' || CASE WHEN len(p) <= 2 THEN p[-1] ELSE array_to_string(p[3:], '/') END AS derived
FROM (SELECT dataset, out_path, string_split(nfc_normalize(out_path), '/') AS p FROM source_manifest WHERE out_path IS NOT NULL)""")
def file_id_derive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter("out_path is not null").select("out_path", file_id(compared(F.col("dataset")), F.col("out_path")).alias("derived")).distinct()


@query("SELECT DISTINCT file_id, CASE WHEN dataset LIKE '%71955%' THEN 'store/' || song_id || '/' || string_split(src_path, '/')[-1] ELSE 'store/' || string_split(src_path, '/')[-1] END AS derived FROM source_manifest WHERE song_id IS NOT NULL OR dataset NOT LIKE '%71955%'")
def output_path_derive(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "source_manifest").filter(F.col("song_id").isNotNull() | ~F.col("dataset").contains("71955"))
    return m.select("file_id", output_path(F.col("dataset").contains("71955"), F.lit("store"), F.col("song_id"), F.col("src_path")).alias("derived")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(r"SELECT DISTINCT instrument_raw, regexp_replace(instrument_raw, '\d+$', '') AS base, string_split(instrument_raw, '_')[-1] AS tail, CASE WHEN starts_with(instrument_raw, 'plucked_') THEN substr(instrument_raw, 9) ELSE string_split(instrument_raw, '_')[-1] END AS short FROM source_manifest WHERE instrument_raw IS NOT NULL")
def regexp_strip_digits(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("instrument_raw")
    return table(spark, d, "source_manifest").filter(raw.isNotNull()).select("instrument_raw", F.regexp_replace(raw, r"\d+$", "").alias("base"), F.element_at(F.split(raw, "_"), -1).alias("tail"), short_name(raw, F.lit("plucked_")).alias("short")).distinct()


@query(f"SELECT file_id, {compared_sql('dataset')} AS dataset, role FROM source_manifest WHERE ({compared_sql('dataset')} = '71470' AND role = 'clip') OR ({compared_sql('dataset')} = '71955' AND role = 'stem')")
def pool_filter(spark: SparkSession, d: str) -> DataFrame:
    """A disjunction of (dataset, role) pairs, pushed to the scan as far as it goes."""
    pairs = {"71470": "clip", "71955": "stem"}
    wanted = reduce(or_, [(F.col("dataset") == name) & (F.col("role") == role) for name, role in pairs.items()])
    m = table(spark, d, "source_manifest").filter(F.col("role").isin(*pairs.values()))
    return m.select("file_id", compared(F.col("dataset")).alias("dataset"), "role").filter(wanted)


@query("SELECT count(*) FILTER (dead IS TRUE) AS dead, count(*) FILTER (dead IS NOT TRUE) AS not_dead, count(*) FILTER (dead IS NULL) AS unknown, count(*) FILTER (coalesce(error, '') <> '') AS errors FROM source_manifest")
def three_state_boolean(spark: SparkSession, d: str) -> DataFrame:
    dead = F.col("dead").eqNullSafe(F.lit(True))
    return table(spark, d, "source_manifest").agg(F.count_if(dead).alias("dead"), F.count_if(~dead).alias("not_dead"), F.count_if(F.col("dead").isNull()).alias("unknown"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


@query("SELECT count(*) FILTER (isfinite(lr_corr)) AS finite_corr, count(*) FILTER (NOT isfinite(lr_corr)) AS not_finite, count(*) FILTER (lr_corr IS NULL) AS no_corr FROM audio_qc")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = F.abs("lr_corr") < float("inf")
    return table(spark, d, "audio_qc").agg(F.count_if(ok).alias("finite_corr"), F.count_if(~ok).alias("not_finite"), F.count_if(F.col("lr_corr").isNull()).alias("no_corr"))


@query("SELECT file_id, src_sr, out_sr FROM source_manifest WHERE src_channels <> out_channels")
def column_vs_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter(F.col("src_channels") != F.col("out_channels")).select("file_id", "src_sr", "out_sr")


@query("SELECT file_id, out_path FROM source_manifest WHERE regexp_matches(out_path, '_[0-9A-Z]{4}\\.wav') AND out_duration >= 10 AND out_duration < 20")
def regex_and_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter(F.col("out_path").rlike(r"_[0-9A-Z]{4}\.wav") & (F.col("out_duration") >= 10) & (F.col("out_duration") < 20)).select("file_id", "out_path")


_CODES = "codes AS (SELECT code_71470, min(instrument_canonical) AS name FROM taxonomy WHERE coalesce(code_71470, '') <> '' GROUP BY code_71470)"


@query(f"WITH {_CODES} SELECT m.file_id, m.ingested_at, CASE WHEN m.role = 'clip' THEN c.name ELSE m.instrument END AS canonical FROM source_manifest m LEFT JOIN codes c ON m.instrument = c.code_71470")
def dictionary_map(spark: SparkSession, d: str) -> DataFrame:
    """Codes become names where the pool writes codes; an unknown code becomes null."""
    codes = table(spark, d, "taxonomy").filter(F.coalesce("code_71470", F.lit("")) != "").groupBy("code_71470").agg(F.min("instrument_canonical").alias("name"))
    m = table(spark, d, "source_manifest")
    return m.join(codes, m["instrument"] == codes["code_71470"], "left").select("file_id", "ingested_at", F.when(F.col("role") == "clip", F.col("name")).otherwise(F.col("instrument")).alias("canonical"))


@query("SELECT file_id AS id, error, CAST(NULL AS VARCHAR) AS note FROM activity_index UNION ALL SELECT file_id, CAST(NULL AS VARCHAR), role FROM stem_duplicate_scan")
def backfill_columns(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activity_index").select("file_id", "error").withColumnRenamed("file_id", "id")
    b = table(spark, d, "stem_duplicate_scan").select(F.col("file_id").alias("id"), F.col("role").alias("note"), "split").drop("split")
    return a.unionByName(b, allowMissingColumns=True)


_ORDER = ["flute", "reed", "drone"]


@query(_M + f"SELECT DISTINCT stem_group, CASE stem_group WHEN 'flute' THEN 0 WHEN 'reed' THEN 1 WHEN 'drone' THEN 2 ELSE 3 END AS ord FROM m WHERE stem_group IS NOT NULL")
def class_order(spark: SparkSession, d: str) -> DataFrame:
    """Modelled classes first, in the given order, then the others."""
    order = spark.createDataFrame([(c, i) for i, c in enumerate(_ORDER)], "stem_group string, ord int")
    return manifest(spark, d).filter("stem_group is not null").select("stem_group").distinct().join(F.broadcast(order), "stem_group", "left").select("stem_group", F.coalesce("ord", F.lit(len(_ORDER))).alias("ord")).orderBy("ord", "stem_group")


# Joins.

_FILES = f"f AS (SELECT {compared_sql('file_id')} AS file_id, max({compared_sql('out_path')}) AS path FROM source_manifest WHERE out_path IS NOT NULL GROUP BY 1)"
_CHECKS = f"qc AS (SELECT {compared_sql('path')} AS path, arg_max(round(duration, 3), k) AS duration, arg_max(channels, k) AS channels FROM (SELECT *, concat_ws('|', checked_at::VARCHAR, coalesce(round(duration, 3), -1)::DECIMAL(12,3)::VARCHAR, coalesce(channels, -1)::VARCHAR) AS k FROM audio_qc) GROUP BY 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").filter("out_path is not null").groupBy(compared(F.col("file_id")).alias("file_id")).agg(F.max(compared(F.col("out_path"))).alias("path"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """The latest check of each path."""
    duration = F.round("duration", 3)
    order = F.concat_ws("|", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.coalesce(duration, F.lit(-1.0)).cast("decimal(12,3)").cast("string"), F.coalesce("channels", F.lit(-1)).cast("string"))
    return table(spark, d, "audio_qc").groupBy(compared(F.col("path")).alias("path")).agg(F.max_by(duration, order).alias("duration"), F.max_by("channels", order).alias("channels"))


@query(f"WITH {_CHECKS}, {_FILES} SELECT file_id, path, duration, channels FROM f JOIN qc USING (path)")
def join_one_to_one_left(spark: SparkSession, d: str) -> DataFrame:
    """Files with their check, exactly one each: those without any are set aside first, and the join raises on any that is left or repeated."""
    checks = _checks(spark, d)
    checked = _files(spark, d).join(checks.select("path"), "path", "left_semi")
    return join_one_to_one(checked, checks, ["path"]).select("file_id", "path", "duration", "channels")


@query(f"WITH {_CHECKS}, {_FILES} SELECT file_id, coalesce(channels, 0)::INT AS channels FROM f LEFT JOIN qc USING (path)")
def join_with_default(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its channels, 0 where no check tells."""
    return lookup_default(_files(spark, d), _checks(spark, d).select("path", "channels"), ["path"], "channels", F.lit(0)).select("file_id", "channels")


_TAX = f"tax AS (SELECT {compared_sql('instrument_canonical')} AS k, max(stem_group) AS tax_group, bool_or(pitched) AS tax_pitched FROM taxonomy GROUP BY 1)"


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "taxonomy").groupBy(compared(F.col("instrument_canonical")).alias("k")).agg(F.max("stem_group").alias("tax_group"), F.bool_or("pitched").alias("tax_pitched"))


@query(f"WITH {_TAX} SELECT tax_group, tax_pitched, count(*) AS n FROM source_manifest LEFT JOIN tax ON {compared_sql('instrument_canonical')} = tax.k GROUP BY ALL")
def taxonomy_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "source_manifest").select(compared(F.col("instrument_canonical")).alias("k"))
    return m.join(_taxonomy(spark, d), "k", "left").groupBy("tax_group", "tax_pitched").agg(F.count("*").alias("n"))


@query(f"WITH {_TAX} SELECT {compared_sql('file_id')} AS file_id, tax_group, tax_pitched FROM source_manifest JOIN tax ON {compared_sql('instrument_canonical')} = tax.k GROUP BY ALL")
def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each file with its instrument's entry; instruments that the taxonomy lacks are set aside first, and the join raises on any that is left."""
    tax = _taxonomy(spark, d)
    m = table(spark, d, "source_manifest").select(compared(F.col("file_id")).alias("file_id"), compared(F.col("instrument_canonical")).alias("k")).filter("k is not null").distinct()
    known = m.join(tax.select("k"), "k", "left_semi")
    return lookup_strict(known, tax, ["k"]).select("file_id", "tax_group", "tax_pitched").distinct()


_GENRE = f"(SELECT {category_sql('song_id')} AS song, min({category_sql('genre_sub')}) AS genre FROM source_manifest WHERE {category_sql('song_id')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {category_sql('genre_sub')}) = 1 AND count({category_sql('genre_sub')}) > 0)"


@query(f"SELECT song, genre FROM {_GENRE}")
def complete_genre_map(spark: SparkSession, d: str) -> DataFrame:
    """Song to genre, asserted: songs with no genre or several are set aside first, and the map raises on any that is left."""
    m = table(spark, d, "source_manifest").select(category("song_id").alias("song"), category("genre_sub").alias("genre")).filter("song is not null")
    single = m.groupBy("song").agg(F.count_distinct("genre").alias("n")).filter("n = 1").select("song")
    return complete_map(m.filter("genre is not null").join(single, "song", "left_semi"), "song", "genre")


_SLOTS = ["flute", "drone", "plucked_high", "hammered"]


@query(f"SELECT * FROM (SELECT DISTINCT {category_sql('stem_group')} AS stem_group FROM source_manifest) LEFT JOIN (VALUES {', '.join(f'({s!r}, {i})' for i, s in enumerate(_SLOTS))}) v(stem_group, slot) USING (stem_group)")
def class_slots(spark: SparkSession, d: str) -> DataFrame:
    """The output slot of each class, by its place in the list that training used."""
    return slotted(table(spark, d, "source_manifest").select(category("stem_group").alias("stem_group")).distinct(), "stem_group", _SLOTS, list(_SLOTS))


@query("SELECT s.file_id, first_row, count(*) AS scans FROM stem_duplicate_scan s LEFT JOIN (SELECT file_id, min(ingested_at) AS first_row FROM source_manifest GROUP BY file_id) m USING (file_id) GROUP BY ALL")
def order_restoring_join(spark: SparkSession, d: str) -> DataFrame:
    """Scan results, which come in any order, put back in the order in which the files were ingested."""
    scans = table(spark, d, "stem_duplicate_scan").groupBy("file_id").agg(F.count("*").alias("scans"))
    order = table(spark, d, "source_manifest").groupBy("file_id").agg(F.min("ingested_at").alias("first_row"))
    return in_order_of(scans, order, ["file_id"], "first_row")


@query("SELECT n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as csv and read back with a stated schema."""
    path = f"{shared_dir(spark)}/nation-{uuid.uuid4().hex}.csv"
    table(spark, d, "nation").select("n_name", "n_regionkey").write.option("header", True).csv(path)
    kind = dict(table(spark, d, "nation").dtypes)["n_regionkey"]
    return csv_scan(spark, path, f"n_name string, n_regionkey {kind}")


@query(f"""
WITH f AS (SELECT {compared_sql('file_id')} AS fid, max(out_frames) AS frames FROM source_manifest WHERE out_frames IS NOT NULL GROUP BY 1), a AS (SELECT {compared_sql('file_id')} AS fid, max(n_blocks) AS blocks FROM activity_index GROUP BY 1)
SELECT fid AS file_id, frames, blocks, frames // 2029 - blocks AS drift FROM f JOIN a USING (fid)""")
def inner_equi_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_manifest").filter("out_frames is not null").groupBy(compared(F.col("file_id")).alias("file_id")).agg(F.max("out_frames").alias("frames"))
    a = table(spark, d, "activity_index").groupBy(compared(F.col("file_id")).alias("file_id")).agg(F.max("n_blocks").alias("blocks"))
    return f.join(a, "file_id").select("file_id", "frames", "blocks", (F.floor(F.col("frames") / 2029) - F.col("blocks")).alias("drift"))


@query(_M + """
SELECT a.stem_group, a.n AS files, b.n AS scans, c.n AS cells FROM (SELECT stem_group, count(*) AS n FROM m GROUP BY 1) a
JOIN (SELECT stem_class AS stem_group, count(*) AS n FROM stem_duplicate_scan GROUP BY 1) b USING (stem_group) JOIN (SELECT stem_group, count(*) AS n FROM activity_summary GROUP BY 1) c USING (stem_group)""")
def chained_inner_joins(spark: SparkSession, d: str) -> DataFrame:
    a = manifest(spark, d).groupBy("stem_group").agg(F.count("*").alias("files"))
    b = table(spark, d, "stem_duplicate_scan").groupBy(F.col("stem_class").alias("stem_group")).agg(F.count("*").alias("scans"))
    c = table(spark, d, "activity_summary").groupBy("stem_group").agg(F.count("*").alias("cells"))
    return a.join(b, "stem_group").join(c, "stem_group")


@query(f"""WITH {_SEGMENTS.strip()}, f AS (SELECT file_id AS series, max(out_frames) AS frames FROM source_manifest WHERE out_frames > 0 GROUP BY file_id)
SELECT series AS file_id, frames, len(list(a)) AS n_segments, array_to_string(list_sort(list(lpad(a::VARCHAR, 2, '0') || '-' || lpad(b::VARCHAR, 2, '0'))), ',') AS segments FROM f JOIN seg USING (series) GROUP BY series, frames""")
def nest_join(spark: SparkSession, d: str) -> DataFrame:
    """Files with their segments nested as structs, shown as text; files without any are dropped."""
    files = table(spark, d, "source_manifest").filter("out_frames > 0").groupBy(F.col("file_id").alias("series")).agg(F.max("out_frames").alias("frames"))
    nested = seq.segments(envelopes(spark, d), RULES).groupBy("series").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("segments"))
    shown = F.transform("segments", lambda s: F.concat(F.lpad(s["start"].cast("string"), 2, "0"), F.lit("-"), F.lpad(s["end"].cast("string"), 2, "0")))
    return files.join(nested, "series").select(F.col("series").alias("file_id"), "frames", F.size("segments").cast("long").alias("n_segments"), F.array_join(shown, ",").alias("segments"))


@query("""
WITH base AS (SELECT song_id, regexp_replace(instrument, '[0-9]+$', '') AS b, count(DISTINCT file_id) AS n FROM stem_duplicate_scan WHERE role = 'stem' AND song_id IS NOT NULL AND instrument IS NOT NULL GROUP BY ALL)
SELECT DISTINCT song_id, genre_sub FROM stem_duplicate_scan WHERE song_id IN (SELECT song_id FROM base WHERE n > 1)""")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Songs that hold an instrument twice."""
    scan = table(spark, d, "stem_duplicate_scan")
    twice = scan.filter("role = 'stem' and song_id is not null and instrument is not null").groupBy("song_id", F.regexp_replace("instrument", "[0-9]+$", "").alias("b")).agg(F.count_distinct("file_id").alias("n")).filter("n > 1")
    return scan.join(twice, "song_id", "left_semi").select("song_id", "genre_sub").distinct()


@query(f"SELECT DISTINCT {compared_sql('instrument_canonical')} AS instrument FROM source_manifest WHERE instrument_canonical IS NOT NULL AND {compared_sql('instrument_canonical')} NOT IN (SELECT {compared_sql('instrument_canonical')} FROM taxonomy)")
def anti_join_unmapped(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "source_manifest").select(compared(F.col("instrument_canonical")).alias("instrument")).filter("instrument is not null").distinct()
    known = table(spark, d, "taxonomy").select(compared(F.col("instrument_canonical")).alias("instrument"))
    return used.join(known, "instrument", "left_anti")


@query(f"WITH {SIGNALS} SELECT a.vec_id, (i)::INT AS pos, a.x[i + 1] AS left_x, b.x[i + 1] AS right_x FROM s a JOIN s b ON b.vec_id = a.vec_id + 1, unnest(range(len(a.x))) t(i)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Each list joined by position with its successor's; both must have the same length."""
    s = signals(spark, d)
    both = s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    checked = both.withColumn("x", F.when(F.size("x") == F.size("y"), F.col("x")).otherwise(F.raise_error(F.lit("lists of different length")).cast("array<double>")))
    return checked.select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("pos", "z")).select("vec_id", "pos", F.col("z.x").alias("left_x"), F.col("z.y").alias("right_x"))


@query("SELECT t AS threshold, count(*) AS n FROM events CROSS JOIN (SELECT unnest([50.0, 100.0, 250.0])::DOUBLE AS t) WHERE value < t GROUP BY t")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """An inequality join with a few thresholds, stated in the query."""
    thresholds = spark.createDataFrame([(50.0,), (100.0,), (250.0,)], "threshold double")
    events = table(spark, d, "events").select("value")
    return events.join(F.broadcast(thresholds), F.col("value") < F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"))


@query("""
WITH spans AS (SELECT l_orderkey AS k, min(l_linenumber) AS a, max(l_linenumber) + 1 AS b FROM lineitem GROUP BY l_orderkey), w AS (SELECT unnest(range(0, 8, 2))::INT AS w0)
SELECT k, w0 // 2 AS window_idx, least(b, w0 + 2) - greatest(a, w0) AS overlap FROM spans JOIN w ON a < w0 + 2 AND b > w0""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals against fixed windows, as an equi-join on the windows an interval touches."""
    spans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("a"), (F.max("l_linenumber") + 1).alias("b"))
    touched = spans.withColumn("window_idx", F.explode(F.sequence(F.floor(F.col("a") / 2).cast("int"), F.floor((F.col("b") - 1) / 2).cast("int"))))
    return touched.select("k", "window_idx", (F.least("b", F.col("window_idx") * 2 + 2) - F.greatest("a", F.col("window_idx") * 2)).alias("overlap"))


@query(_M + "SELECT a.dataset, b.stem_group, count(m.file_id) AS n FROM (SELECT DISTINCT dataset FROM m WHERE dataset IS NOT NULL) a CROSS JOIN (SELECT DISTINCT stem_group FROM m WHERE stem_group IS NOT NULL) b LEFT JOIN m ON m.dataset = a.dataset AND m.stem_group = b.stem_group GROUP BY ALL")
def cross_class_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A dense grid of two small category sets, with counts."""
    m = manifest(spark, d)
    counts = m.groupBy("dataset", "stem_group").agg(F.count("file_id").alias("n"))
    grid = counts.filter("dataset is not null").select("dataset").distinct().crossJoin(counts.filter("stem_group is not null").select("stem_group").distinct())
    return grid.join(counts, ["dataset", "stem_group"], "left").fillna(0, ["n"])


@query("""
SELECT m.song_id, s.file_id AS stem, round(s.frac_master_energy_explained, 5) AS explained FROM (SELECT DISTINCT song_id FROM stem_duplicate_scan WHERE role = 'master' AND song_id IS NOT NULL) m
JOIN stem_duplicate_scan s ON s.song_id = m.song_id AND s.role = 'stem' WHERE s.frac_master_energy_explained > 0.5 AND isfinite(s.frac_master_energy_explained)""")
def master_stem_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    """Stems beside the master of their song; songs that lack either are out."""
    scan, x = table(spark, d, "stem_duplicate_scan"), F.col("frac_master_energy_explained")
    masters = scan.filter("role = 'master' and song_id is not null").select("song_id").distinct()
    return scan.filter((F.col("role") == "stem") & (x > 0.5) & (x < float("inf"))).join(masters, "song_id", "left_semi").select("song_id", F.col("file_id").alias("stem"), F.round(x, 5).alias("explained"))


@query("SELECT file_id, max(ingested_at) AS latest, count(*) AS n_rows FROM source_manifest GROUP BY file_id")
def latest_per_file(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "source_manifest").select("file_id", "ingested_at")
    latest = dedupe_latest(m, ["file_id"], ["ingested_at"]).withColumnRenamed("ingested_at", "latest")
    return latest.join(m.groupBy("file_id").agg(F.count("*").alias("n_rows")), "file_id")


# Set operations.


@query("SELECT file_id, n_blocks, role FROM (SELECT file_id, n_blocks, NULL::VARCHAR AS role FROM activity_index UNION ALL SELECT file_id, NULL, role FROM stem_duplicate_scan)")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """Two tables scanned as one; what one lacks is null there."""
    return union_scan(spark, [f"{d}/activity_index.parquet", f"{d}/stem_duplicate_scan.parquet"]).select("file_id", "n_blocks", "role")


@query("SELECT song_id, min(genre_sub) AS genre FROM stem_duplicate_scan WHERE song_id IS NOT NULL AND genre_sub IS NOT NULL GROUP BY song_id")
def distinct_on_subset(spark: SparkSession, d: str) -> DataFrame:
    return dedupe_latest(table(spark, d, "stem_duplicate_scan").filter("song_id is not null and genre_sub is not null").select("song_id", F.col("genre_sub").alias("genre")), ["song_id"], [], ["genre"])


@query("SELECT DISTINCT file_id FROM (SELECT file_id FROM activity_index EXCEPT SELECT file_id FROM source_manifest)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activity_index").select("file_id").subtract(table(spark, d, "source_manifest").select("file_id"))


@query("SELECT file_id, n FROM (SELECT file_id, count(*) OVER (PARTITION BY dataset, out_frames, peak, rms) AS n FROM source_manifest WHERE out_frames IS NOT NULL AND isfinite(peak)) WHERE n > 1")
def duplicate_fingerprint_all_members(spark: SparkSession, d: str) -> DataFrame:
    """All members of groups that share a fingerprint; aggregated first, so a group is never one task's window."""
    key = ["dataset", "out_frames", "peak", "rms"]
    m = table(spark, d, "source_manifest").filter(F.col("out_frames").isNotNull() & (F.abs("peak") < float("inf"))).select("file_id", *key)
    groups = m.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    same = [m[c].eqNullSafe(groups[c]) for c in key]
    return m.join(groups, same).select("file_id", "n")


@query("""
WITH g AS (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT d.doc_id, g.first_doc, g.n FROM documents d JOIN g ON md5(d.text) = g.h""")
def content_hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("h"))
    groups = docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")
    return docs.join(groups, "h").select("doc_id", "first_doc", "n")


@query("""
SELECT excerpt_md5, count(*) AS members FROM (SELECT DISTINCT excerpt_md5, file_id FROM stem_duplicate_scan WHERE excerpt_md5 IS NOT NULL AND len(list_distinct(excerpt_levels)) > 1) GROUP BY 1 HAVING count(*) > 1""")
def signal_duplicates_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Files that share a hash, constant signals left out."""
    s = table(spark, d, "stem_duplicate_scan").filter(F.col("excerpt_md5").isNotNull() & (F.size(F.array_distinct("excerpt_levels")) > 1))
    return s.select("excerpt_md5", "file_id").distinct().groupBy("excerpt_md5").agg(F.count("*").alias("members")).filter("members > 1")


@query(_M + "SELECT (SELECT list_sort(list(DISTINCT stem_group)) FROM m WHERE dataset = '71470') = (SELECT list_sort(list(DISTINCT stem_group)) FROM m WHERE dataset = '71955') AS equal_sets")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    def own(name: str):
        return F.sort_array(F.collect_set(F.when(F.col("dataset") == name, F.col("stem_group"))))

    return manifest(spark, d).agg((own("71470") == own("71955")).alias("equal_sets"))


# Anomalies and rankings.


@query(_M + """
, f AS (SELECT dataset, quantile_cont(seconds, 0.75) + 3 * (quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25)) AS fence FROM m GROUP BY dataset)
SELECT m.file_id, m.dataset, round(m.seconds, 3) AS seconds, round(f.fence, 3) AS fence FROM m JOIN f USING (dataset) WHERE m.seconds > f.fence""")
def outlier_fence_per_group(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).select("file_id", "dataset", "seconds")
    fences = iqr_fence(m, ["dataset"], "seconds", 3.0)
    return m.join(fences, "dataset").filter(F.col("seconds") > F.col("fence")).select("file_id", "dataset", F.round("seconds", 3).alias("seconds"), F.round("fence", 3).alias("fence"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def topk_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id)::INT AS rank FROM documents) WHERE rank <= 15")
def bottomk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("rank")).filter("rank <= 15")


@query("SELECT stem_class, song_id, round(x, 5) AS best FROM (SELECT stem_class, song_id, corr_with_master AS x, row_number() OVER (PARTITION BY stem_class ORDER BY corr_with_master DESC, file_id, scanned_at) AS r FROM stem_duplicate_scan WHERE isfinite(corr_with_master) AND stem_class IS NOT NULL) WHERE r = 1")
def argmax_per_class(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stem_duplicate_scan").filter((F.abs("corr_with_master") < float("inf")) & F.col("stem_class").isNotNull())
    best = s.groupBy("stem_class").agg(F.max("corr_with_master").alias("x"))
    ties = s.join(best, ["stem_class"]).filter(F.col("corr_with_master") == F.col("x")).groupBy("stem_class", "x").agg(F.min_by("song_id", F.struct("file_id", "scanned_at")).alias("song_id"))
    return ties.select("stem_class", "song_id", F.round("x", 5).alias("best"))


@query(_M + "SELECT instrument_raw, n, datasets FROM (SELECT instrument_raw, count(*) AS n, array_to_string(list_sort(list(DISTINCT dataset)), '+') AS datasets FROM m WHERE instrument_raw IS NOT NULL GROUP BY 1) ORDER BY n DESC, instrument_raw LIMIT 10")
def topn_with_label(spark: SparkSession, d: str) -> DataFrame:
    groups = manifest(spark, d).filter("instrument_raw is not null").groupBy("instrument_raw").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("dataset")), "+").alias("datasets"))
    return groups.orderBy(F.desc("n"), "instrument_raw").limit(10)
