"""References to records that do not exist, were withdrawn, or arrived later than the reference.

Keys are text, so each is first split without loss into (template, number): its longest run of
digits, replaced wherever it occurs by a mark, and the rest. Parent numbers of one template are
sorted and compressed into contiguous runs (start, end, and what holds for all members); a reference is
matched as-of to the run with the nearest start at or before its number, and dangles where its
number lies beyond that run's end. Runs never cross a block of BLOCK numbers, so
(target, template, block) is an equi-key that spreads the work and bounds each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarloom.functions.text import compared
from sonarloom.operators.skew import hot_keys
from sonarloom.session import cut

#: Numbers per block, a power of 2: bounds the rows of one window group.
BLOCK = 1024
_MARK, _WHOLE = "\x01", "\x02"


def _digits(key: Column) -> Column:
    """The first of a key's longest runs of digits, by class of length; null where there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")) for pattern in ("([0-9]{6,18})", "([0-9]{3,5})", "([0-9]{1,2})")])


def located(df: DataFrame) -> DataFrame:
    """Adds template, n and block to rows with a key: template and n together give back the key, so equal pairs mean equal keys.

    Up to 18 digits make a number. Keys without digits, or with the marks themselves, stay whole as a template with number 0.
    """
    key, digits = F.col("key"), F.col("_d")
    return (
        df.withColumn("_d", F.when(~(key.contains(_MARK) | key.contains(_WHOLE)), _digits(key)))
        .withColumn("template", F.when(digits.isNull(), F.concat(F.lit(_WHOLE), key)).otherwise(F.concat(F.length(digits).cast("string"), F.lit(_MARK), F.replace(key, digits, F.lit(_MARK)))))
        .withColumn("n", F.coalesce(digits.cast("long"), F.lit(0)))
        .withColumn("block", F.shiftright("n", BLOCK.bit_length() - 1))
        .drop("_d")
    )


def parent_state(parents: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per (target, key) that has a parent row: earliest arrival, and whether it is withdrawn now.

    parents: target, key, arrived. removed: target, key, removed_at. Null keys match nothing. A key is
    withdrawn if its latest removal is at or after its latest arrival; without any time there it is not.
    """
    both = parents.select("target", "key", "arrived", F.lit(None).cast("timestamp_ntz").alias("removed_at"), F.lit(1).alias("there")).unionByName(
        removed.select("target", "key", F.lit(None).cast("timestamp_ntz").alias("arrived"), "removed_at", F.lit(0).alias("there"))
    )
    return (
        both.groupBy("target", "key")
        .agg(F.min("arrived").alias("first"), F.max("arrived").alias("last"), F.max("removed_at").alias("gone"), F.max("there").alias("there"))
        .filter(F.col("there") == 1)
        .select("target", "key", "first", F.coalesce(F.col("gone") >= F.col("last"), F.lit(False)).alias("withdrawn"))
    )


def parent_runs(state: DataFrame) -> DataFrame:
    """Contiguous runs of parent numbers: target, template, block, run(start, end, latest, withdrawn).

    latest: the latest of the members' first arrivals; withdrawn: whether any member is.
    """
    w = Window.partitionBy("target", "template", "block").orderBy("n")
    return (
        located(state)
        .withColumn("island", F.col("n") - F.row_number().over(w))
        .groupBy("target", "template", "block", "island")
        .agg(F.min("n").alias("start"), F.max("n").alias("end"), F.max("first").alias("latest"), F.bool_or("withdrawn").alias("withdrawn"))
        .select("target", "template", "block", F.struct("start", "end", "latest", "withdrawn").alias("run"))
    )


def verdicts(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Of the referred keys (target, key, since: earliest own time) those that may dangle: target, key, reason, arrived.

    reason is missing, withdrawn or late; late holds for references before `arrived` only. A run says at
    once which keys lie beyond its end, and which are sure to be sound, as none of its members is
    withdrawn or came after the reference. Only the keys in doubt look up their own member.
    """
    runs = parent_runs(state)
    asked = located(keys).select("target", "template", "block", F.col("n").alias("at"), F.lit(1).alias("kind"), "key", "since", F.lit(None).cast(runs.schema["run"].dataType).alias("run"))
    starts = runs.select("target", "template", "block", F.col("run.start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("timestamp_ntz").alias("since"), "run")
    w = Window.partitionBy("target", "template", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(starts).withColumn("run", F.last("run", ignorenulls=True).over(w)).filter(F.col("kind") == 1)
    beyond = F.col("run").isNull() | (F.col("at") > F.col("run.end"))
    doubtful = F.col("run.withdrawn") | (F.col("since") < F.col("run.latest"))
    return (
        found.select("target", "key", "since", beyond.alias("beyond"), doubtful.alias("doubtful")).filter("beyond or doubtful")
        .join(state, ["target", "key"], "left")
        .withColumn("reason", F.when(F.col("beyond"), "missing").when(F.col("withdrawn"), "withdrawn").when(F.col("since") < F.col("first"), "late"))
        .filter(F.col("reason").isNotNull())
        .select("target", "key", "reason", F.col("first").alias("arrived"))
    )


def dangling_references(refs: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """The references whose key the target lacks, withdrew, or got only after the reference.

    refs: target, key, own_time and any other columns, which are kept; keys in compared form in all
    three. Adds reason. Null keys are no references; a null own time is never late. Repeated rows
    each count. Empty inputs: no parents makes every reference missing, no references gives no rows.
    References are first reduced to their distinct keys, so a key that a third of all rows refer to
    is matched once. On the way back hot keys bring their verdict by broadcast (they are few by
    definition): sound ones leave before the shuffle, the rows of the others are spread over it.
    """
    names = refs.drop("reason").columns
    refs = refs.select(*names).filter(F.col("key").isNotNull())
    keys = cut(refs.groupBy("target", "key").agg(F.min("own_time").alias("since"), F.count("*").alias("n")), "referred")
    state = cut(parent_state(parents, removed), "parent-state")  # read for the runs and for their members in doubt
    bad = cut(verdicts(keys.drop("n"), state), "verdicts")
    hot = hot_keys(keys, ["target", "key"]).join(bad, ["target", "key"], "left").select("target", "key", F.lit(True).alias("_hot"), F.col("reason").alias("_hot_reason"), F.col("arrived").alias("_hot_arrived"))
    marked = refs.join(F.broadcast(hot), ["target", "key"], "left").filter("_hot is null or _hot_reason is not null")
    spread = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(*names), F.lit(1 << 20))).otherwise(0)
    cold = bad.select("target", "key", F.lit(0).cast("long").alias("_s"), "reason", F.col("arrived").alias("_arrived"))
    found = (
        marked.withColumn("_s", spread.cast("long")).join(cold, ["target", "key", "_s"], "left")
        .withColumn("reason", F.coalesce("reason", "_hot_reason")).withColumn("_arrived", F.coalesce("_arrived", "_hot_arrived"))
    )
    late = F.col("reason") == "late"
    return found.filter(F.col("reason").isNotNull() & (~late | (F.col("own_time") < F.col("_arrived")))).select(*names, "reason")


def reference_rows(table: DataFrame, ref_table: str, id_column: str, time_column: str, fields: dict[str, str]) -> DataFrame:
    """References of one table in a single scan. fields: field -> target table."""
    each = [F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), compared(F.col(f)).alias("key")) for f, t in fields.items()]
    return table.select(compared(F.col(id_column)).alias("file_id"), F.col(time_column).alias("own_time"), F.inline(F.array(*each))).withColumn("ref_table", F.lit(ref_table))


def parent_rows(table: DataFrame, target: str, key_column: str, time_column: str) -> DataFrame:
    return table.filter(F.col(key_column).isNotNull()).select(F.lit(target).alias("target"), compared(F.col(key_column)).alias("key"), F.col(time_column).alias("arrived"))
