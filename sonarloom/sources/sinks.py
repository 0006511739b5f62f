"""Sinks: parquet with a csv twin, appends that skip what is there, markdown of small results."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarloom.session import cut
from sonarloom.sources.files import suffix_paths, table_paths


def write_twins(df: DataFrame, base: str, keys: list[str], dry_run: bool = False, paths: Callable[[str], tuple[str, str]] = table_paths) -> tuple[str, str]:
    """Parquet and csv, rows in order of keys. A dry run plans and writes nothing. paths: the layout, table_paths or suffix_paths."""
    parquet, csv = paths(base)
    ordered = df.orderBy(*keys)
    if not dry_run:
        ordered.write.mode("overwrite").parquet(parquet)
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.sparkSession.read.parquet(parquet).select(*flat).orderBy(*keys).write.mode("overwrite").option("header", True).csv(csv)
    return parquet, csv


def write_tables(tables: dict[str, DataFrame], folder: str, keys: dict[str, list[str]], dry_run: bool = False) -> dict[str, tuple[str, str]]:
    """Twins of several tables by name, and one markdown file of them all, folder/tables.md. Gives the twins' paths."""
    paths = {name: write_twins(df, f"{folder}/{name}", keys[name], dry_run, suffix_paths) for name, df in tables.items()}
    if not dry_run:
        shown = "\n\n".join(f"## {name}\n\n{to_markdown(df.orderBy(*keys[name]))}" for name, df in tables.items())
        where, name = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        with where.open_output_stream(f"{name}/tables.md") as f:
            f.write((shown + "\n").encode())
    return paths


def summary_lines(df: DataFrame, by: list[str], hours: str | None = None, most: int = 100) -> list[str]:
    """A report for people to read: one line per group, largest first, and the total."""
    total = F.round(F.sum(hours) / 3600, 2) if hours else F.lit(None)
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), total.alias("h")).orderBy(F.desc("n"), *by).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} groups are no report to read")
    lines = [f"{' / '.join('-' if r[c] is None else str(r[c]) for c in by)}: {r['n']}" + (f" files, {r['h'] or 0:.2f} h" if hours else "") for r in rows]
    return [*lines, f"total: {sum(r['n'] for r in rows)}"]


def append_missing(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Append the rows whose key the table lacks; gives all of df's keys with `cached` for those it had.

    With overwrite, all rows are written anew.
    """
    spark = df.sparkSession
    there = None
    if not overwrite:
        try:
            there = spark.read.parquet(path).select(*keys).distinct()
        except Exception as x:  # no table yet
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
    if there is None:
        df.write.mode("overwrite").parquet(path)
        return df.select(*keys, F.lit(False).alias("cached"))
    marked = cut(df.select(*keys).join(there.withColumn("cached", F.lit(True)), keys, "left").select(*keys, F.coalesce("cached", F.lit(False)).alias("cached")), "cached")
    df.join(marked.filter("not cached").select(*keys), keys, "left_semi").write.mode("append").parquet(path)
    return marked


def write_envelopes(blocks: DataFrame, path: str) -> None:
    """Envelopes in files sorted by series and block, so that one file's stretch is a few row groups."""
    blocks.repartitionByRange("path", "block").sortWithinPartitions("path", "block").write.mode("overwrite").parquet(path)


def read_envelopes(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Stretches of stored envelopes: ranges has path, first, n. Files are sorted by path and block, so few row groups are read."""
    stored = spark.read.parquet(path)
    return stored.join(ranges, "path").filter((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("n"))).select(*stored.columns)


def to_markdown(df: DataFrame, formats: dict[str, str] | None = None, most: int = 1000) -> str:
    """A small result as a markdown table; null and NaN are a dash. More rows than `most` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table to read")

    def shown(c: str, v: object) -> str:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "—"
        return format(v, (formats or {}).get(c, ".3f" if isinstance(v, float) else ""))

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(c, r[c]) for c in df.columns) + " |" for r in rows])
