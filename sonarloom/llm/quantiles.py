"""Percentiles of very large columns with a bounded rank error, from sketches that combine.

Deterministic buffer collapsing: a sketch holds at most BUFFERS sorted buffers of `size` values, each
with a weight (how many input values one of them stands for). A full set of buffers is collapsed:
the lightest, as equals in weight as can be, merge, and of their weighted order evenly spaced
positions are kept. Partly filled buffers of one weight are first filled from one another. Sketches
of partitions, days or file sets merge the same way into that of the whole. A collapse to weight w
moves a rank by at most (w + 1) / 2; each sketch carries the sum of these, so its answers come with
a proven bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUFFERS = 10
#: Values that the open sketches of one task hold before they are handed on.
HELD = 4_000_000
STATE_COLUMNS = ["n", "error", "weights", "values"]
STATE = "n long, error double, weights array<double>, values array<array<double>>"


def size_for(epsilon: float) -> int:
    """Values of a buffer so that ranks are off by epsilon x n at most, for up to 10^12 values.

    A level of the tree collapses buffers of n / size weight in all, and moves a rank by 3/4 of that
    at most; ten buffers reach 10^12 values in 34 levels. Each sketch states the bound it really has.
    """
    return math.ceil(26 / epsilon)


SIZE = size_for(0.01)


class Sketch:
    """n values seen, rank error so far, and buffers (weight, sorted values)."""

    def __init__(self, size: int = SIZE) -> None:
        self.size, self.n, self.error = size, 0, 0.0
        self.buffers: list[tuple[float, np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        """Add finite values of any number and order."""
        for i in range(0, len(values), self.size):
            self.n += len(values[i : i + self.size])
            self.buffers.append((1.0, np.sort(values[i : i + self.size])))
            self._shrink()

    def merge(self, n: int, error: float, weights, values) -> None:
        self.n += int(n)
        self.error += float(error)
        self.buffers += [(float(w), np.asarray(v, float)) for w, v in zip(weights, values)]
        self._shrink()

    def _shrink(self) -> None:
        while len(self.buffers) > BUFFERS:
            if not self._repack():
                self.buffers.sort(key=lambda b: b[0])
                # The tree's schedule: all of the lightest weight together, two buffers at least.
                self._collapse(max(2, sum(w <= self.buffers[1][0] for w, _ in self.buffers)))

    def _repack(self) -> bool:
        """Fill partly filled buffers of one weight from one another, without loss. True if any was saved."""
        before, full = len(self.buffers), [b for b in self.buffers if len(b[1]) >= self.size]
        partial: dict[float, list[np.ndarray]] = {}
        for w, v in self.buffers:
            if len(v) < self.size:
                partial.setdefault(w, []).append(v)
        for w, parts in partial.items():
            values = np.concatenate(parts)
            full += [(w, np.sort(values[i : i + self.size])) for i in range(0, len(values), self.size)]
        self.buffers = full
        return len(full) < before

    def _collapse(self, take: int) -> None:
        taken, self.buffers = self.buffers[:take], self.buffers[take:]
        values = np.concatenate([v for _, v in taken])
        order = np.argsort(values, kind="stable")
        mass = np.cumsum(np.concatenate([np.full(len(v), w) for w, v in taken])[order])
        # Evenly spaced positions: the middle of each of `size` equal stretches of the weighted order.
        weight = mass[-1] / self.size
        at = np.minimum(np.searchsorted(mass, (np.arange(self.size) + 0.5) * weight), len(values) - 1)
        self.buffers.append((weight, values[order][at]))
        self.error += (weight + 1) / 2

    def quantiles(self, shares: list[float]) -> tuple[list[float | None], float]:
        """Values at those shares, and the largest distance of their rank from the true one."""
        if not self.n:
            return [None] * len(shares), 0.0
        values = np.concatenate([v for _, v in self.buffers])
        order = np.argsort(values, kind="stable")
        mass = np.cumsum(np.concatenate([np.full(len(v), w) for w, v in self.buffers])[order])
        wanted = np.clip(np.ceil(np.array(shares) * self.n), 1, self.n)
        at = np.minimum(np.searchsorted(mass, wanted - 1e-6), len(values) - 1)
        heaviest = max(w for w, _ in self.buffers)
        return values[order][at].tolist(), self.error + (heaviest / 2 if heaviest > 1 else 0)

    def held(self) -> int:
        return 16 + sum(len(v) for _, v in self.buffers)

    def state(self) -> dict:
        return {"n": self.n, "error": self.error, "weights": [w for w, _ in self.buffers], "values": [v.tolist() for _, v in self.buffers]}


def sketches(df: DataFrame, group: list[str], values: dict[str, Column], size: int = SIZE) -> DataFrame:
    """One sketch per group and measure: group columns (as strings), measure, and the sketch's state.

    values: measure -> numeric column. Null, NaN and infinity are no values; groups without any
    value have no row, a null group is a group of its own. Repeated rows count each. Every task
    sketches what it reads, in one pass over the rows, and hands its sketches on whenever they hold HELD
    values; sketches then merge in a tree. Which values a sketch keeps depends on how the rows lie in
    partitions, its bound holds for any; sketches of up to BUFFERS x size values keep them all.
    """
    names = list(values)
    cells = df.select(*[F.col(g).cast("string").alias(g) for g in group], *[F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")).alias(f"_v{i}") for i, c in enumerate(values.values())])
    fields = "".join(f"{g} string, " for g in group)
    schema = f"{fields}measure string, slot int, {STATE}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple, Sketch] = {}
        slot = TaskContext.get().partitionId() % 1024

        def handed_on() -> Iterator[pd.DataFrame]:
            rows = list(own.items())
            own.clear()
            for i in range(0, len(rows), 256):
                yield pd.DataFrame([dict(zip([*group, "measure"], key)) | {"slot": slot} | s.state() for key, s in rows[i : i + 256]])

        for frame in frames:
            for i, name in enumerate(names):
                some = frame[frame[f"_v{i}"].notna()]
                if not len(some):
                    continue
                for key, part in some.groupby(group, dropna=False, sort=False)[f"_v{i}"]:
                    key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                    own.setdefault((*key, name), Sketch(size)).add(part.to_numpy(float))
            if sum(s.held() for s in own.values()) > HELD:
                yield from handed_on()
        yield from handed_on()

    return merge_sketches(cells.mapInPandas(run, schema), group, size)


def merge_sketches(parts: DataFrame, group: list[str], size: int = SIZE) -> DataFrame:
    """Merge sketches (of partitions, days, file sets) into one per group and measure.

    group: the columns to keep apart. With a slot column, sketches merge per slot first: a tree, so that
    no task takes more of one group than the sketches of a slot.
    """
    if "slot" in parts.columns:
        parts = _merged(parts.withColumn("slot", F.col("slot") % 32), [*group, "measure", "slot"], size).drop("slot")
    return _merged(parts.select(*group, "measure", *STATE_COLUMNS), [*group, "measure"], size)


def _merged(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One sketch per key. Rows come sorted by key, so a task holds one sketch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, sketch, out = None, None, []
        for frame in frames:
            cells = [frame[k].astype(object).where(frame[k].notna(), None) for k in keys]
            for key, n, error, weights, values in zip(zip(*cells), frame["n"], frame["error"], frame["weights"], frame["values"]):
                if key != open_key or sketch is None:
                    if sketch is not None:
                        out.append(dict(zip(keys, open_key)) | sketch.state())
                    open_key, sketch = key, Sketch(size)
                sketch.merge(n, error, weights, values)
            if len(out) >= 256:
                yield pd.DataFrame(out)
                out = []
        if sketch is not None:
            out.append(dict(zip(keys, open_key)) | sketch.state())
        if out:
            yield pd.DataFrame(out)

    fields = ", ".join(f"{k} int" if k == "slot" else f"{k} string" for k in keys)
    # Sketches of one key merge in one order, whatever order they arrive in.
    ordered = parts.select(*keys, *STATE_COLUMNS).repartition(*keys).sortWithinPartitions(*keys, "n", "error", "values")
    return ordered.mapInPandas(run, f"{fields}, {STATE}")


def percentiles(merged: DataFrame, group: list[str], shares: list[float], size: int = SIZE) -> DataFrame:
    """Group columns, measure, share, n, value, and rank_error: how many ranks value may be off, at most."""
    fields = "".join(f"{g} string, " for g in group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.rename(columns={"values": "values_"}).to_dict("records"):
                sketch = Sketch(size)
                sketch.n, sketch.error = int(row["n"]), float(row["error"])
                sketch.buffers = [(float(w), np.asarray(v, float)) for w, v in zip(row["weights"], row["values_"])]
                found, error = sketch.quantiles(shares)
                out += [{g: row[g] for g in group} | {"measure": row["measure"], "share": s, "n": sketch.n, "value": v, "rank_error": error} for s, v in zip(shares, found)]
            if out:
                yield pd.DataFrame(out)

    return merged.mapInPandas(run, f"{fields}measure string, share double, n long, value double, rank_error double")
