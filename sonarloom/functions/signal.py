"""Array kernels of short signals, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda it would be computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(_sum(x), F.size(x))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(energy(x), F.size(x)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def to_db(amplitude: Column, floor: float = -120.0) -> Column:
    """20 log10 with a floor; 0 and below are the floor."""
    return F.when(amplitude <= 0, floor).otherwise(F.greatest(F.lit(floor), 20 * F.log10(amplitude)))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def crest_db(x: Column) -> Column:
    return F.when((peak(x) > 0) & (rms(x) > 0), 20 * F.log10(peak(x) / rms(x)))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def share_over(x: Column, level: float) -> Column:
    return F.try_divide(F.size(F.filter(x, lambda v: F.abs(v) >= level)), F.size(x))


def dc_removed(x: Column) -> Column:
    return _let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def peak_clamped(x: Column, ceiling: float, target: float) -> Column:
    """Scaled down to target, only where the peak is over ceiling."""
    return _let(peak(x), lambda p: F.when(p > ceiling, F.transform(x, lambda v: v * target / p)).otherwise(x))


def downmixed(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def gain(x: Column, y: Column) -> Column:
    """Least squares y ~ gain x through the origin; 0 for a silent x."""
    return F.coalesce(F.try_divide(dot(x, y), F.nullif(energy(x), F.lit(0.0))), F.lit(0.0))


def explained(x: Column, y: Column) -> Column:
    """Share of y's energy that the best gain of x explains."""
    return F.coalesce(F.try_divide(dot(x, y) * dot(x, y), F.nullif(energy(x) * energy(y), F.lit(0.0))), F.lit(0.0))


def block_rms_db(x: Column, size: int, floor: float = -240.0) -> Column:
    """Levels of whole blocks; the rest at the end is dropped."""
    starts = F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1)
    blocks = F.transform(starts, lambda i: to_db(rms(F.slice(x, i * size + 1, size)), floor))
    return F.when(F.size(x) >= size, blocks).otherwise(F.array().cast("array<double>"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson; a constant side gives 1 if both are equal, else 0."""
    a, b = dc_removed(x), dc_removed(y)
    r = F.try_divide(dot(a, b), F.nullif(F.sqrt(energy(a) * energy(b)), F.lit(0.0)))
    return F.coalesce(r, F.when(x == y, 1.0).otherwise(0.0))


def _best_lag(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """The inner products of all shifts at once, by FFT."""
    n = min(len(x), len(y))
    if not n:
        return None
    x, y, most = x[:n], y[:n], min(most, n - 1)
    size = 1 << (2 * n - 1).bit_length()
    products = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    shifts = np.array(sorted(range(-most, most + 1), key=lambda k: (abs(k), -k)))
    return int(shifts[np.argmax(np.round(products[shifts], 9))])


def lag(x: Column, y: Column, most: int, probe: int | None = None) -> Column:
    """Shift of y against x with the largest inner product, within +-most; ties to the smallest shift, then to the positive.

    probe: only so many values around the middle are compared. Arrays of different length are compared as far as both go.
    """

    @F.pandas_udf(IntegerType())
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys):
            if a is None or b is None:
                out.append(None)
                continue
            a, b = np.asarray(a, float), np.asarray(b, float)
            n = min(len(a), len(b))
            first = max(0, (n - probe) // 2) if probe else 0
            last = min(n, first + probe) if probe else n
            out.append(_best_lag(a[first:last], b[first:last], most))
        return pd.Series(out, dtype="Int32")

    return run(x, y)


@F.pandas_udf(StringType())
def sample_digest(x: pd.Series) -> pd.Series:
    """md5 of the values' bytes, as 32-bit floats; null where all values are equal, as silence is no content."""
    import hashlib

    def one(v) -> str | None:
        if v is None:
            return None
        v = np.asarray(v, "<f4")
        return hashlib.md5(v.tobytes()).hexdigest() if len(v) and (v != v[0]).any() else None

    return x.map(one)


def decimated(x: Column, every: int) -> Column:
    """Every so manieth value, from the first."""
    return F.filter(x, lambda _, i: i % every == 0)


def centred(x: Column, size: int) -> Column:
    """`size` values around the middle; all of a shorter array."""
    return F.slice(x, F.greatest(F.lit(1), F.floor((F.size(x) - size) / 2).cast("int") + 1), size)


def picked_channel(channels: Column, which: int = 0) -> Column:
    """One channel of an array of channels, as an array of one."""
    return F.slice(channels, which + 1, 1)


def to_stereo(channels: Column) -> Column:
    """Mono twice, anything else as it is."""
    return F.when(F.size(channels) == 1, F.concat(channels, channels)).otherwise(channels)


def swapped(channels: Column) -> Column:
    return F.reverse(channels)


def close_to(x: Column, y: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Whether all values of x are those of y, but for absolute + relative x |y|."""
    return (F.size(x) == F.size(y)) & F.forall(F.arrays_zip(x.alias("a"), y.alias("b")), lambda z: F.abs(z["a"] - z["b"]) <= absolute + relative * F.abs(z["b"]))


def mono_envelope_db(channels: Column, rate: int, block_s: float = 0.1, floor: float = 1e-12) -> Column:
    """Levels of whole blocks of the mean of all channels, in dB; amplitudes below floor count as it."""
    size = max(1, round(block_s * rate))
    mono = F.transform(channels[0], lambda _, i: _sum(F.transform(channels, lambda c: F.get(c, i))) / F.size(channels))
    return _let(mono, lambda x: F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), lambda b: 20 * F.log10(F.greatest(F.lit(floor), rms(F.slice(x, b * size + 1, size)))))).otherwise(F.array().cast("array<double>")))


def prefix_energy(x: Column) -> Column:
    """Running sums of squares, from 0: the energy of any window is the difference of two of them."""
    return F.aggregate(x, F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v * v)))
