"""WAV files as a source: headers, decoded blocks, and block levels, in bounded memory.

Plain PCM (16, 24, 32 bit) and 32-bit float RIFF files are read here without a codec library; other
formats, and files shorter than their header says, give a row with `error` set. Nothing raises for a bad file.
Paths may be local or URIs of any file system that pyarrow opens, read by seeking, on the executors.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarloom.functions.loudness import integrated_loudness, resampled

HEADER = "path string, sr int, subtype string, channels int, frames long, duration double, error string"
ENVELOPE = "path string, block int, db float, error string"


def parse_header(f: BinaryIO) -> tuple[int, str, int, int, int, int]:
    """(rate, subtype, channels, frames, offset of the data, bytes per sample), stepping from chunk to chunk, whatever lies before the data."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = f.read(min(size, 40))
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE:
                code = struct.unpack("<H", body[24:26])[0]
            form = (code, channels, rate, align, bits)
        elif name == b"data":
            if not form:
                raise ValueError("data before format")
            code, channels, rate, align, bits = form
            if code not in (1, 3) or not channels or not align:
                raise ValueError(f"format {code} is not read")
            return rate, f"PCM_{bits}" if code == 1 else "FLOAT", channels, size // align, at + 8, bits // 8
        at += 8 + size + size % 2
        f.seek(at)
    raise ValueError("no data chunk")


def _whole(f: BinaryIO, count: int) -> bytes:
    """Exactly so many bytes: a file that ends before is an error, not silence."""
    raw = f.read(count)
    if len(raw) < count:
        raise ValueError(f"the file ends {count - len(raw)} bytes before its header says")
    return raw


def samples(raw: bytes, subtype: str, channels: int) -> np.ndarray:
    """(frames, channels) as float32 in [-1, 1]."""
    if subtype == "FLOAT":
        flat = np.frombuffer(raw, "<f4")
    elif subtype == "PCM_16":
        flat = np.frombuffer(raw, "<i2") / np.float32(1 << 15)
    elif subtype == "PCM_24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / np.float32(1 << 23)
    elif subtype == "PCM_32":
        flat = np.frombuffer(raw, "<i4") / np.float32(1 << 31)
    else:
        raise ValueError(f"{subtype} is not read")
    return flat.astype(np.float32).reshape(-1, channels)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open(path: str) -> BinaryIO:
    where, name = _place(path)
    return where.open_input_file(name)


def headers(files: DataFrame) -> DataFrame:
    """files: path. Header facts of each, without decoding. A zero rate gives a null duration."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    with _open(path) as f:
                        rate, subtype, channels, n, _, _ = parse_header(f)
                    out.append((path, rate, subtype, channels, n, n / rate if rate else None, ""))
                except (OSError, ValueError, struct.error) as x:
                    out.append((path, None, None, None, None, None, str(x)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADER.split(", ")])

    return files.select("path").mapInPandas(run, HEADER)


def envelope(files: DataFrame, block_s: float, blocks_per_read: int = 4096, max_seconds: float | None = None, floor: float = -240.0) -> DataFrame:
    """Level of each whole block: root mean square per channel, the loudest channel, in dB.

    Reads are whole blocks, so a file of any length takes the same memory; a partial block at the end is
    dropped. Energy is summed in double precision. A bad file gives one row with error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                try:
                    with _open(path) as f:
                        rate, subtype, channels, n, at, width = parse_header(f)
                        size = max(1, round(block_s * rate))
                        n = n if max_seconds is None else min(n, int(max_seconds * rate))
                        f.seek(at)
                        for first in range(0, n // size, blocks_per_read):
                            count = min(blocks_per_read, n // size - first)
                            x = samples(_whole(f, count * size * channels * width), subtype, channels).astype(np.float64)
                            power = (x[: len(x) // size * size].reshape(-1, size, channels) ** 2).mean(1).max(1)
                            db = np.maximum(10 * np.log10(np.maximum(power, 1e-30)), floor)
                            yield pd.DataFrame({"path": path, "block": np.arange(first, first + len(db), dtype=np.int32), "db": db.astype(np.float32), "error": ""})
                except (OSError, ValueError, struct.error) as x:
                    yield pd.DataFrame({"path": [path], "block": [None], "db": [None], "error": [str(x)]})

    return files.select("path").mapInPandas(run, ENVELOPE)


def excerpt(path: str, start: int, frames: int) -> np.ndarray:
    """Frames [start, start + frames) of one file; beyond its end they are 0."""
    with _open(path) as f:
        _, subtype, channels, n, at, width = parse_header(f)
        f.seek(at + start * channels * width)
        got = samples(_whole(f, max(0, min(frames, n - start)) * channels * width), subtype, channels)
    return np.vstack([got, np.zeros((frames - len(got), channels), np.float32)])


def excerpts(windows: DataFrame) -> DataFrame:
    """windows: path, start, frames (null: all from start). Adds sr, and x: an array of channels, each of so many values; beyond the end they are 0. A bad file has an error."""
    schema = "path string, start long, frames long, sr int, x array<array<float>>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, n in zip(frame["path"], frame["start"], frame["frames"]):
                start, n = (None if pd.isna(v) else int(v) for v in (start, n))
                try:
                    with _open(path) as f:
                        rate, _, _, there, _, _ = parse_header(f)
                    x = excerpt(path, start or 0, max(0, there - (start or 0)) if n is None else n)
                    out = (path, start, n, rate, [c.tolist() for c in x.T], "")
                except (OSError, ValueError, struct.error) as e:
                    out = (path, start, n, None, None, str(e))
                one = pd.DataFrame([out], columns=[c.split()[0] for c in schema.split(", ")])
                yield one.astype({"start": "Int64", "frames": "Int64", "sr": "Int32"})

    return windows.select("path", F.col("start").cast("long"), F.col("frames").cast("long")).mapInPandas(run, schema)


def decoded(files: DataFrame) -> DataFrame:
    """files: path. Whole files as arrays of channels; see excerpts."""
    return excerpts(files.select("path", F.lit(0).alias("start"), F.lit(None).alias("frames")))


def write_wav(path: str, x: np.ndarray, rate: int) -> None:
    """(frames, channels) in [-1, 1] as 24-bit PCM. Written aside and renamed, so that a lost or repeated task leaves no half of a file."""
    flat = np.clip(np.round(x * (1 << 23)), -(1 << 23), (1 << 23) - 1).astype("<i4").ravel()
    raw = flat.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    channels = x.shape[1]
    where, name = _place(path)
    where.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    aside = f"{name}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(aside) as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + len(raw) + len(raw) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 3, channels * 3, 24))
        f.write(b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2))
    where.move(aside, name)


def _written(path: str) -> tuple[int, int, int] | None:
    """(rate, channels, frames) of a file that is there and as long as its header says; else null."""
    where, name = _place(path)
    if where.get_file_info(name).type != fs.FileType.File:
        return None
    try:
        with _open(path) as f:
            rate, _, channels, n, at, width = parse_header(f)
            return (rate, channels, n) if f.size() >= at + n * channels * width else None
    except (OSError, ValueError, struct.error):
        return None


def write(signals: DataFrame) -> DataFrame:
    """signals: path, x (an array of channels), sr. Writes each as a 24-bit file; gives path, frames, error."""
    schema = "path string, frames long, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, x, rate in zip(frame["path"], frame["x"], frame["sr"]):
                try:
                    channels = np.stack([np.asarray(c, float) for c in x], 1)
                    write_wav(path, channels, int(rate))
                    out.append((path, len(channels), ""))
                except (OSError, ValueError, TypeError) as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "frames", "error"]).astype({"frames": "Int64"})

    return signals.select("path", "x", "sr").mapInPandas(run, schema)


INGESTED = "src_path string, out_path string, src_sr int, out_sr int, src_channels int, out_channels int, src_frames long, out_frames long, out_duration double, channel_action string, resampled boolean, peak_before double, peak_after double, peak_normalized boolean, ops_applied string, cached boolean, error string"


def _read(path: str) -> tuple[int, np.ndarray]:
    with _open(path) as f:
        rate, subtype, channels, n, at, width = parse_header(f)
        f.seek(at)
        return rate, samples(_whole(f, n * channels * width), subtype, channels).astype(np.float64)


# The labels of what was done to a file are those of the manifest's ops_applied.
def _ingest_one(source: str, target: str, action: str | None, rate: int, ceiling: float, peak: float, overwrite: bool, dry_run: bool, channel: int = 0) -> dict:
    row = {"src_path": source, "out_path": target, "channel_action": action, "cached": False, "error": "", "ops_applied": ""}
    try:
        with _open(source) as f:
            src_sr, _, channels, frames, _, _ = parse_header(f)
        row |= {"src_sr": src_sr, "src_channels": channels, "src_frames": frames}
        if not overwrite and (there := _written(target)):
            out_sr, out_channels, n = there
            return row | {"out_sr": out_sr, "out_channels": out_channels, "out_frames": n, "out_duration": round(n / out_sr, 3), "cached": True, "ops_applied": "cached"}
        if dry_run:
            return row | {"ops_applied": "dry_run"}
        _, x = _read(source)
        ops = []
        if action == "pick_channel":
            x, ops = x[:, channel : channel + 1], ["pick_channel"]
        if len(x):
            x = x - x.mean(0)
            ops.append("dc")
        if src_sr != rate:
            x = resampled(x, src_sr, rate)
            ops.append(f"resample({src_sr}->{rate})")
        before = float(np.abs(x).max()) if x.size else 0.0
        if before > ceiling:
            x = x * (peak / before)
            ops.append("peak")
        write_wav(target, x, rate)
        after = float(np.abs(x).max()) if x.size else 0.0
        return row | {"out_sr": rate, "out_channels": x.shape[1], "out_frames": len(x), "out_duration": round(len(x) / rate, 3), "resampled": src_sr != rate, "peak_before": round(before, 6), "peak_after": round(after, 6), "peak_normalized": before > ceiling, "ops_applied": ";".join(ops)}
    except Exception as x:  # a bad file is a row, never a failed job
        return row | {"error": f"{type(x).__name__}: {x}"}


def ingest(tasks: DataFrame, rate: int = 44100, ceiling: float = 1.0, peak: float = 0.99, overwrite: bool = False, dry_run: bool = False, channel: int = 0) -> DataFrame:
    """tasks: src_path, out_path, channel_action. One row per file: channel choice, DC, resampling, peak, 24-bit write.

    Files that are there already, whole, are only read again (`cached`), unless overwrite; `channel` is the one that is picked. A dry run writes nothing.
    Paths must be reachable from every executor.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in INGESTED.split(", ")]
        for frame in frames:
            rows = [_ingest_one(s, t, a, rate, ceiling, peak, overwrite, dry_run, channel) for s, t, a in zip(frame["src_path"], frame["out_path"], frame["channel_action"])]
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    return tasks.select("src_path", "out_path", "channel_action").mapInPandas(run, INGESTED)


def loudness(windows: DataFrame) -> DataFrame:
    """windows: path, start, frames (null frames: the whole file). Adds lufs, peak, crest_db, channels, error.

    Mono counts once; add MONO_DUPLICATION_DB where it is played on two channels. Silence has -inf.
    """
    schema = "path string, start long, frames long, lufs double, peak double, crest_db double, channels int, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, start, n in zip(frame["path"], frame["start"], frame["frames"]):
                start, n = (None if pd.isna(v) else int(v) for v in (start, n))
                try:
                    with _open(path) as f:
                        rate = parse_header(f)[0]
                    x = _read(path)[1] if n is None else excerpt(path, start or 0, n).astype(np.float64)
                    top, rms = float(np.abs(x).max()) if x.size else 0.0, float(np.sqrt((x**2).mean())) if x.size else 0.0
                    out.append((path, start, n, integrated_loudness(x, rate), top, 20 * np.log10(top / rms) if top > 0 and rms > 0 else None, x.shape[1], ""))
                except (OSError, ValueError, struct.error) as e:
                    out.append((path, start, n, None, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            for c in ("start", "frames", "channels"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return windows.select("path", "start", "frames").mapInPandas(run, schema)


RENDERED = "item long, path string, lufs double, gain double, peak double, error string"


def render(plan: DataFrame, folder: str, window_frames: int, rate: int, target_lufs: float, ceiling: float = 0.99) -> DataFrame:
    """Mixtures of planned items, written as folder/<item>.wav. plan: item, path, start_frame, gain, swapped; a row per stem.

    Stems are cut, mono ones doubled, gained and swapped as planned, and summed; the sum is brought to
    target_lufs by one gain and, if its peak is over the ceiling, under it by another. Silence keeps its
    level. An item is one small group; a bad file gives its item an error.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        item = int(rows["item"].iloc[0])
        path = f"{folder.rstrip('/')}/{item}.wav"
        try:
            mixture = np.zeros((window_frames, 2))
            for row in rows.sort_values(["path", "start_frame"]).to_dict("records"):
                with _open(row["path"]) as f:
                    found = parse_header(f)[0]
                if found != rate:
                    raise ValueError(f"{row['path']} has rate {found}")
                x = excerpt(row["path"], int(row["start_frame"]), window_frames).astype(np.float64)
                x = np.repeat(x, 2, axis=1) if x.shape[1] == 1 else x[:, :2]
                mixture += (x[:, ::-1] if row["swapped"] else x) * (1.0 if pd.isna(row["gain"]) else row["gain"])
            lufs = integrated_loudness(mixture, rate)
            gain = 10 ** ((target_lufs - lufs) / 20) if np.isfinite(lufs) else 1.0
            top = float(np.abs(mixture).max()) * gain if mixture.size else 0.0
            gain *= ceiling / top if top > ceiling else 1.0
            write_wav(path, mixture * gain, rate)
            return pd.DataFrame([(item, path, lufs if np.isfinite(lufs) else None, gain, min(top, ceiling) if top > ceiling else top, "")], columns=[c.split()[0] for c in RENDERED.split(", ")])
        except Exception as e:  # a bad file is a row, never a failed job
            return pd.DataFrame([(item, path, None, None, None, f"{type(e).__name__}: {e}")], columns=[c.split()[0] for c in RENDERED.split(", ")])

    return plan.select("item", "path", "start_frame", "gain", "swapped").groupBy("item").applyInPandas(one, RENDERED)


def equalised(x: np.ndarray, rate: int, bands: list[tuple[str, float, float, float]]) -> np.ndarray:
    """(frames, channels) through a chain of bands (low, peak or high; corner in Hz, gain in dB, q), by the second-order sections' frequency response."""
    if not len(x) or not bands:
        return x
    n = 1 << int(len(x) + rate // 4).bit_length()
    z = np.exp(-1j * np.pi * np.arange(n // 2 + 1) / (n // 2))
    out = np.ones(len(z), complex)
    for kind, corner, gain, q in bands:
        a, w = 10 ** (gain / 40), 2 * np.pi * corner / rate
        alpha, c, root = np.sin(w) / (2 * q), np.cos(w), 2 * np.sqrt(a) * np.sin(w) / (2 * q)
        if kind == "peak":
            b, d = (1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)
        else:
            s = 1 if kind == "low" else -1
            b = (a * (a + 1 - s * (a - 1) * c + root), s * 2 * a * (a - 1 - s * (a + 1) * c), a * (a + 1 - s * (a - 1) * c - root))
            d = (a + 1 + s * (a - 1) * c + root, -s * 2 * (a - 1 + s * (a + 1) * c), a + 1 + s * (a - 1) * c - root)
        out *= (b[0] + b[1] * z + b[2] * z**2) / (d[0] + d[1] * z + d[2] * z**2)
    return np.fft.irfft(np.fft.rfft(x, n, axis=0) * out[:, None], n, axis=0)[: len(x)]


def random_bands(u: list[float], gain_db: float, q_max: float, rate: int) -> list[tuple[str, float, float, float]]:
    """A low shelf, up to four peaks and a high shelf from uniform draws u (14 or more), in ascending frequency."""
    count = int(u[0] * 5)
    draws = iter(u[1:])

    def band(kind: str, low: float, high: float, q: float) -> tuple[str, float, float, float]:
        return kind, low * (high / low) ** next(draws), (2 * next(draws) - 1) * gain_db, q

    peaks = sorted((band("peak", 200.0, min(8000.0, 0.4 * rate), 0.5 + (q_max - 0.5) * u[-1 - k]) for k in range(count)), key=lambda b: b[1])
    return [band("low", 60.0, 200.0, 0.7), *peaks, band("high", min(4000.0, 0.2 * rate), min(12000.0, 0.45 * rate), 0.7)]
