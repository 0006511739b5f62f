"""Gated programme loudness (ITU-R BS.1770) and band-limited resampling, in numpy.

Filters act through their frequency response on the zero-padded signal. Resampling is spectral; it
stands in for a polyphase resampler library and agrees with one inside the pass band.
"""

from __future__ import annotations

import math

import numpy as np

#: What copying mono to two channels adds.
MONO_DUPLICATION_DB = 10 * math.log10(2)


def _biquad(kind: str, gain_db: float, q: float, corner: float, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Second-order section by the bilinear transform of its analogue prototype."""
    k = math.tan(math.pi * corner / rate)
    a = np.array([1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])
    if kind == "shelf":
        high = 10 ** (gain_db / 20)
        middle = high**0.4996667741545416
        b = np.array([high + middle * k / q + k * k, 2 * (k * k - high), high - middle * k / q + k * k])
    else:
        b = np.array([1.0, -2.0, 1.0]) * a[0]
    return b / a[0], a / a[0]


def _response(rate: int, bins: int) -> np.ndarray:
    """K-weighting on `bins` frequencies from 0 to half the rate."""
    z = np.exp(-1j * np.pi * np.arange(bins) / (bins - 1))
    out = np.ones(bins, complex)
    # The standard's two filters.
    for kind, gain, q, corner in (("shelf", 3.999843853973347, 0.7071752369554196, 1681.974450955533), ("high", 0.0, 0.5003270373238773, 38.13547087602444)):
        b, a = _biquad(kind, gain, q, corner, rate)
        out *= (b[0] + b[1] * z + b[2] * z**2) / (a[0] + a[1] * z + a[2] * z**2)
    return out


def integrated_loudness(x: np.ndarray, rate: int) -> float:
    """LUFS of (frames, channels); -inf where nothing passes the gates or less than a 0.4 s block is there."""
    size, hop = int(round(0.4 * rate)), int(round(0.1 * rate))
    if len(x) < size:
        return -math.inf
    n = 1 << int(len(x) + rate).bit_length()
    weighted = np.fft.irfft(np.fft.rfft(x, n, axis=0) * _response(rate, n // 2 + 1)[:, None], n, axis=0)[: len(x)]
    energy = np.vstack([np.zeros(x.shape[1]), np.cumsum(weighted**2, axis=0)])
    starts = np.arange(0, len(x) - size + 1, hop)
    power = ((energy[starts + size] - energy[starts]) / size).sum(1)
    with np.errstate(divide="ignore"):
        level = -0.691 + 10 * np.log10(np.maximum(power, 0))
    loud = power[level > -70]
    if not len(loud):
        return -math.inf
    relative = -0.691 + 10 * math.log10(loud.mean()) - 10
    kept = power[(level > -70) & (level > relative)]
    return -0.691 + 10 * math.log10(kept.mean()) if len(kept) else -math.inf


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """(frames, channels) at another rate; the same array if the rates are equal."""
    if source == target or not len(x):
        return x
    n = max(1, round(len(x) * target / source))
    spectrum = np.fft.rfft(x, axis=0)
    kept = np.zeros((n // 2 + 1, x.shape[1]), complex)
    m = min(len(spectrum), len(kept))
    kept[:m] = spectrum[:m]
    return (np.fft.irfft(kept, n, axis=0) * (n / len(x))).astype(x.dtype)
