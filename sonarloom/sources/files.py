"""Sources over files: listings, tables with back-filled columns, labels, taxonomies, configurations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = T.StructType([T.StructField("music_type_info", T.StructType([T.StructField("instrument_cd", T.StringType()), T.StructField("music_genre_cd", T.StringType())]))])
TAXONOMY = "instrument_canonical string, stem_group string, pitched boolean, instrument_group_71955 string, code_71470 string"


def listing(spark: SparkSession, root: str, pattern: str = "*.wav", dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Files under root: dataset, role (master where the stem ends in _master), path, bytes; with a limit, the first so many by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    found = files.select(F.lit(dataset).alias("dataset"), F.when(stem.endswith("_master"), "master").otherwise("stem").alias("role"), "path", "bytes")
    # Only the head of a list has an order; a sort of everything would be for show.
    return found if limit is None else found.orderBy("path").limit(limit)


def folders(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Folders that hold matching files: folder, files, in no order."""
    files = listing(spark, root, pattern).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    return files.groupBy("folder").agg(F.count("*").alias("files"))


def union_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tables as one; columns that one lacks are null there."""
    tables = [spark.read.parquet(p) for p in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def csv_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """JSON labels, one file each: clip_id (file name), instrument_cd, music_genre_cd. Unreadable files have nulls."""
    read = spark.read.schema(LABEL).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return read.select(name.alias("clip_id"), "music_type_info.instrument_cd", "music_type_info.music_genre_cd")


def taxonomy(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """A taxonomy given as instrument -> attributes."""
    rows = [(k, v.get("stem_group"), v.get("pitched"), v.get("group_71955"), v.get("code_71470") or None) for k, v in entries.items()]
    return spark.createDataFrame(rows, TAXONOMY)


def taxonomy_file(spark: SparkSession, path: str, section: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(taxonomy, code -> instrument) of a JSON file, or a YAML one where a YAML library is installed. Empty codes are none; a code given twice is an error."""
    from sonarloom.config import read_mapping

    entries = read_mapping(path)
    entries = entries[section] if section else entries
    codes: dict[str, str] = {}
    for name, v in entries.items():
        if code := v.get("code_71470"):
            if code in codes:
                raise ValueError(f"{code} is the code of {codes[code]} and of {name}")
            codes[code] = name
    return taxonomy(spark, entries), codes


def pinned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; missing ones are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every float column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def suffix_paths(base: str) -> tuple[str, str]:
    """Parquet and csv twin side by side, told apart by suffix; a suffix that base has is replaced."""
    p = Path(base)
    return str(p.with_suffix(".parquet")), str(p.with_suffix(".csv"))


def table_paths(base: str) -> tuple[str, str]:
    """Of a table's base path, where its parquet and its csv twin lie."""
    p = Path(base)
    return str(p.parent / "parquet" / f"{p.name}.parquet"), str(p.parent / "csv" / f"{p.name}.csv")
