"""Samples whose category shares match targets, by a divisor method's priorities.

Within each category records take a random rank r; a record's priority is (r - 0.5) / target share,
its category's floor records come first, and the globally smallest priorities are kept. Where a category
runs out, its seats go on to the others by themselves. How many records of a category lie below the
cut follows from the categories' counts alone, so no global sort of records is needed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.text import compared
from sonarloom.operators.prefix import random_rank
from sonarloom.operators.sampling import uniform_md5
from sonarloom.session import cut

#: Rows of targets that the driver takes: a stated table of categories.
MAX_TARGETS = 1_000_000
#: Combinations of targeted categories that a joint sample plans for.
MAX_CELLS = 1_000_000


def seats(available: list[int], shares: list[float], floors: list[int], size: int) -> list[int]:
    """Seats of each category: floors first, then the smallest priorities (r - 0.5) / share until size is full.

    Ties go to the earlier category. If the floors alone exceed size they stand, and the sample is larger.
    """
    first = [min(f, n) for f, n in zip(floors, available)]
    most = [n if s > 0 else f for n, s, f in zip(available, shares, first)]

    def taken(theta: float) -> list[int]:
        return [max(f, min(m, math.floor(theta * s + 0.5))) for f, m, s in zip(first, most, shares)]

    if sum(most) <= size:
        return most
    low, high = 0.0, 1.0
    while sum(taken(high)) < size:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if sum(taken(middle)) < size else (low, middle)
    out, full = taken(low), taken(high)
    for k in range(len(out)):  # those that tie at the cut
        out[k] += max(0, min(full[k] - out[k], size - sum(out)))
    return out


def memberships(files: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct category_field, category (compared form, lower case), file_id. Null categories and ids are out."""
    if not fields:
        return files.sparkSession.createDataFrame([], "file_id string, category_field string, category string")
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("category_field"), F.lower(compared(F.col(f))).alias("category")) for f in fields]))
    return files.select(compared(F.col("file_id")).alias("file_id"), each).filter("category is not null and file_id is not null").distinct()


def proportional_sample(files: DataFrame, targets: DataFrame, share: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report): for each category_field of targets, a sample of share x the number of distinct files.

    files: file_id and a column for each category_field; a file counts in a category if any of its
    rows has it (case ignored), and once. sample: category_field, category, file_id, rank, priority.
    report, a row for each target: available (the last rank its records reach), needed (the larger of
    min_files and target_share x share x files), entitled (records among the first `needed` ranks), drawn,
    drawn_share, enough (the ranks reach what is needed), reached (min_files and the share, within half a
    percent of the sample, were drawn: other categories' floors may take seats from one that has enough).
    Categories without target are not drawn; a null target_share or min_files is 0. No files: empty
    sample, and every target that asks for any has not enough. Ranks are by md5: any engine can redraw them.
    """
    targets = targets.fillna(0, ["target_share", "min_files"]).filter("category_field is not null")
    wanted = targets.select("category_field", F.col("category").alias("written"), F.lower(compared(F.col("category"))).alias("category"), "target_share", "min_files")
    fields = sorted(r[0] for r in targets.select("category_field").distinct().collect())
    members = memberships(files, fields)
    total = files.select(F.count_distinct(compared(F.col("file_id")))).head()[0]
    size = round(share * total)
    needed = F.greatest(F.col("min_files").cast("double"), F.col("target_share") * share * total)
    # A category's records take their ranks once; all that follows reads them.
    drawable = cut(members.join(F.broadcast(wanted.filter("category is not null").groupBy("category_field", "category").agg(F.max(needed).alias("needed"))), ["category_field", "category"]), "members")
    u = uniform_md5(F.lit(str(seed)), F.col("category_field"), F.col("category"), F.col("file_id"))
    ranked = cut(random_rank(drawable, ["category_field", "category"], ["file_id"], seed, u=u), "ranked")
    ranks = ranked.groupBy("category_field", "category").agg(F.max("rank").alias("available"), F.count_if(F.col("rank") <= F.ceil("needed")).alias("entitled"))
    rows = wanted.join(ranks, ["category_field", "category"], "left").fillna(0, ["available", "entitled"]).orderBy("category_field", "written").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("more targets than a stated table of categories should hold")
    planned = []
    for field in fields:
        own = [r for r in rows if r["category_field"] == field]
        given = seats([r["available"] for r in own], [r["target_share"] for r in own], [r["min_files"] for r in own], size)
        planned += [(field, r["category"], r["written"], r["target_share"], r["min_files"], r["available"], r["entitled"], max(float(r["min_files"]), r["target_share"] * share * total), s) for r, s in zip(own, given)]
    plan = files.sparkSession.createDataFrame(planned, "category_field string, category string, written string, target_share double, min_files int, available long, entitled long, needed double, seats long")
    chosen = ranked.drop("needed").join(F.broadcast(plan.filter("seats > 0").select("category_field", "category", "written", "target_share", "min_files", "seats")), ["category_field", "category"])
    priority = F.when(F.col("rank") <= F.col("min_files"), 0.0).otherwise((F.col("rank") - 0.5) / F.col("target_share"))
    sample = chosen.filter(F.col("rank") <= F.col("seats")).select("category_field", F.col("written").alias("category"), "file_id", "rank", priority.alias("priority"))
    drawn = sample.groupBy("category_field", "category").agg(F.count("*").alias("drawn"))
    drawn_share = F.coalesce(F.try_divide(F.col("drawn"), F.lit(float(size))), F.lit(0.0))
    report = (
        plan.drop("category").withColumnRenamed("written", "category").join(drawn, ["category_field", "category"], "left").fillna(0, ["drawn"])
        .withColumn("drawn_share", drawn_share).withColumn("enough", F.col("entitled") >= F.col("needed"))
        .withColumn("reached", (F.col("drawn") >= F.col("min_files")) & (F.col("drawn_share") >= F.col("target_share") - 0.005))
    )
    return sample, report


def fitted(cells: list[tuple[str, ...]], available: list[int], wanted: list[dict[str, float]], rounds: int = 200) -> np.ndarray:
    """Expected records of each cell so that every field's categories reach `wanted`, as far as the cells hold them.

    Iterative proportional fitting under a cap: the cells of a category are scaled to its target, those
    that are full stay full and the others take the rest.
    """
    have = np.array(available, float)
    x = have.copy()
    where = [{c: np.array([k for k, cell in enumerate(cells) if cell[f] == c], int) for c in own} for f, own in enumerate(wanted)]
    for _ in range(rounds):
        before = x.copy()
        for f, own in enumerate(wanted):
            for c, target in own.items():
                at = where[f][c]
                for _ in range(4):
                    free = at[x[at] < have[at] - 1e-9] if x[at].sum() < target else at
                    full = x[at].sum() - x[free].sum()
                    if not len(free) or x[free].sum() <= 0:
                        break
                    x[free] = np.minimum(have[free], x[free] * max(0.0, target - full) / x[free].sum())
                    if abs(x[at].sum() - target) < 1e-6:
                        break
        if np.abs(x - before).max(initial=0) < 1e-6:
            break
    return x


def refilled(shares: dict[str, float], have: dict[str, int], floors: dict[str, int], size: int) -> dict[str, float]:
    """Records of each category for a sample of size: shares, at least the floors; what exhausted ones lack goes to the others."""
    out = {c: float(min(have[c], floors[c])) for c in shares}
    fixed: set[str] = set()
    while True:
        free = [c for c in shares if c not in fixed and shares[c] > 0]
        rest = size - sum(out[c] for c in shares if c not in free)
        weight = sum(shares[c] for c in free)
        tight = {c for c in free if not min(have[c], floors[c]) < shares[c] * rest / weight < have[c]} if free else set()
        over = {c for c in tight if shares[c] * rest / weight >= have[c]} or tight
        if not over:
            return out | {c: shares[c] * rest / weight for c in free}
        for c in over:
            out[c] = float(have[c]) if shares[c] * rest / weight >= have[c] else float(min(have[c], floors[c]))
        fixed |= over


def joint_sample(files: DataFrame, targets: DataFrame, share: float = 0.2, seed: int = 1, latest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, report): one sample of share x the number of distinct files that matches all fields at once.

    A file counts with one row, the greatest by the column `latest` (and then by its categories), and can be
    drawn if it has a targeted category in every field. What exhausted categories lack goes to the others of their field. Each combination of categories is a cell; cell
    targets are fitted to all fields' shares, and records are drawn by the divisor method over cells.
    sample: file_id, cell (the categories, in order of field), rank. report: category_field, category,
    target_share, min_files, available (among files that can be drawn), drawn, drawn_share (of the sample), reached
    (at least min_files drawn, and the share reached within half a percent of the sample).
    """
    targets = targets.fillna(0, ["target_share", "min_files"]).filter("category_field is not null and category is not null")
    given = targets.select("category_field", "category", F.lower(compared(F.col("category"))).alias("key"), "target_share", "min_files").limit(MAX_TARGETS + 1).collect()
    if len(given) > MAX_TARGETS:
        raise ValueError("more targets than a stated table of categories should hold")
    fields = sorted({r["category_field"] for r in given})
    spark = files.sparkSession
    report_schema = "category_field string, category string, target_share double, min_files int, available long, drawn long, drawn_share double, reached boolean"
    if not fields:
        return spark.createDataFrame([], "file_id string, cell array<string>, rank long"), spark.createDataFrame([], report_schema)
    keys = [F.lower(compared(F.col(f))) for f in fields]
    newest = F.col(latest) if latest else F.lit(0)
    one = files.filter(F.col("file_id").isNotNull()).groupBy(compared(F.col("file_id")).alias("file_id")).agg(F.max(F.struct(newest.alias("t"), F.array(*keys).alias("cell")))["cell"].alias("cell"))
    known = [F.element_at("cell", f + 1).isin([r["key"] for r in given if r["category_field"] == name]) for f, name in enumerate(fields)]
    drawable = cut(one, "one-per-file")
    total = drawable.count()
    for k in known:
        drawable = drawable.filter(k)
    counted = drawable.groupBy("cell").count().orderBy("cell").limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS:
        raise ValueError("the targets combine to more cells than a plan should hold")
    cells, available = [tuple(r["cell"]) for r in counted], [r["count"] for r in counted]
    size = round(share * total)
    wanted = []
    for f, name in enumerate(fields):
        own = [r for r in given if r["category_field"] == name]
        have = {r["key"]: sum(n for c, n in zip(cells, available) if c[f] == r["key"]) for r in own}
        wanted.append(refilled({r["key"]: r["target_share"] for r in own}, have, {r["key"]: r["min_files"] for r in own}, min(size, sum(available))))
    x = fitted(cells, available, wanted)
    given_seats = seats(available, x.tolist(), [int(v) for v in np.floor(x + 1e-9)], min(size, round(float(x.sum()))))
    # At most MAX_CELLS rows: Spark broadcasts them where they are small.
    plan = spark.createDataFrame([(list(c), s) for c, s in zip(cells, given_seats) if s], "cell array<string>, seats long")
    ranked = random_rank(drawable.join(plan, "cell"), ["cell"], ["file_id"], seed, rows=max(available, default=0))
    sample = ranked.filter(F.col("rank") <= F.col("seats")).select("file_id", "cell", "rank")
    drawn = sum(given_seats)
    lines = []
    for f, name in enumerate(fields):
        for r in (r for r in given if r["category_field"] == name):
            at = [k for k, c in enumerate(cells) if c[f] == r["key"]]
            got = sum(given_seats[k] for k in at)
            reached = got / drawn if drawn else 0.0
            lines.append((name, r["category"], float(r["target_share"]), int(r["min_files"]), sum(available[k] for k in at), got, reached, got >= r["min_files"] and reached >= r["target_share"] - 0.005))
    return sample, spark.createDataFrame(lines, report_schema)
