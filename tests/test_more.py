import math
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarloom import config
from sonarloom.functions.loudness import integrated_loudness, resampled
from sonarloom.operators import history as h
from sonarloom.operators.prefix import ordered_rank
from sonarloom.operators.regression import ridge
from sonarloom.sources import audio


def sine(rate, seconds, hz=997.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)[:, None]


def test_loudness_of_reference_tone():
    for rate in (44100, 48000):
        x = sine(rate, 5)
        assert integrated_loudness(x, rate) == pytest.approx(-3.01, abs=0.05)
        assert integrated_loudness(np.hstack([x, x]), rate) == pytest.approx(0.0, abs=0.05)
        assert integrated_loudness(x * 0.1, rate) == pytest.approx(-23.01, abs=0.05)
        gated = np.vstack([x, np.zeros((rate * 20, 1))])
        assert integrated_loudness(gated, rate) == pytest.approx(-3.01, abs=0.3)
    assert integrated_loudness(np.zeros((48000, 1)), 48000) == -math.inf
    assert integrated_loudness(sine(48000, 0.1), 48000) == -math.inf


def test_resampling_keeps_the_tone():
    x = resampled(sine(48000, 1, 1000), 48000, 44100)
    assert len(x) == 44100 and np.abs(x - sine(44100, 1, 1000)).max() < 1e-6
    assert resampled(x, 44100, 44100) is x


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    audio.write_wav(str(tmp_path / "in/a.wav"), np.hstack([sine(48000, 1) * 0.5 + 0.1] * 2), 48000)
    (tmp_path / "in/bad.wav").write_bytes(b"RIFF")
    tasks = spark.createDataFrame([(str(tmp_path / f"in/{n}.wav"), str(tmp_path / f"out/{n}.wav"), "pick_channel") for n in ("a", "bad")], "src_path string, out_path string, channel_action string")
    assert {r["ops_applied"] for r in audio.ingest(tasks, dry_run=True).collect() if not r["error"]} == {"dry_run"} and not (tmp_path / "out").exists()
    got = {r["src_path"].rsplit("/", 1)[1]: r for r in audio.ingest(tasks).collect()}
    a = got["a.wav"]
    assert (a["out_sr"], a["out_channels"], a["out_frames"], a["ops_applied"], a["cached"]) == (44100, 1, 44100, "pick_channel;dc;resample(48000->44100)", False)
    assert got["bad.wav"]["error"] and a["peak_after"] == pytest.approx(0.5, abs=0.01)
    assert [r["cached"] for r in audio.ingest(tasks).collect() if not r["error"]] == [True]
    levels = spark.createDataFrame([(a["out_path"], None, None), (a["out_path"], 100, 30000), ("nowhere", 0, 1)], "path string, start long, frames long")
    rows = audio.loudness(levels).collect()
    assert rows[0]["lufs"] == pytest.approx(-9.03, abs=0.1) and rows[0]["crest_db"] == pytest.approx(3.01, abs=0.1) and rows[1]["lufs"] == pytest.approx(-9.03, abs=0.1) and rows[2]["error"]


@dataclass
class Settings:
    rate: int = 1
    name: str = "x"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"rate": 7}}')
    assert config.load(Settings, str(tmp_path / "c.json"), "a") == Settings(7, "x")
    with pytest.raises(KeyError):
        config.from_mapping(Settings, {"rat": 1})
    assert config.rooted("a/b", "/r") == "/r/a/b" and config.rooted("/a", "/r") == "/a"


def test_history(spark):
    metrics = {"epoch_2": {"sdr": {"a": [1.0, 3.0], "b": [math.nan, 4.0]}}, "epoch_10": {"sdr": {"a": [1.0, 1.0], "b": [2.0, 2.0]}}}
    rows = h.flatten(spark.createDataFrame([(metrics,)], "metrics map<string, map<string, map<string, array<double>>>>"))
    scores = h.trajectory(rows, "sdr")
    assert [(r["epoch"], r["score"], r["is_best"]) for r in scores.orderBy("epoch").collect()] == [(2, 3.0, True), (10, 1.5, False)]
    best = h.best_epoch(scores).head()
    assert (best["best_epoch"], best["last_epoch"]) == (2, 10)
    songs = spark.createDataFrame([("a", 0, "s1"), ("a", 1, "s2"), ("b", 0, "s1"), ("b", 1, "s3")], "class string, position int, song_id string")
    assert h.per_song(rows, "sdr", 2, songs).count() == 4
    with pytest.raises(Exception, match="without a song"):
        h.per_song(rows, "sdr", 2, songs.filter("position = 0")).collect()


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(1.0, None, 3.0)], "a double, b double, y double")
    got = ridge(df, ["a", "b"], "y", 0.0)
    assert got == pytest.approx({"a": 2.0, "b": -1.0})
    assert ridge(df.limit(0), ["a"], "y") == {"a": 0.0}


def test_ordered_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, "g").alias("g")).repartition(5)
    got = ordered_rank(df, ["g"], [F.desc("v"), F.asc("id")], total="n").collect()
    for g in ("g", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and {r["n"] for r in own} == {len(own)}
        assert [r["id"] for r in own] == [r["id"] for r in sorted(own, key=lambda r: (-r["v"], r["id"]))]
    assert ordered_rank(df.limit(0), ["g"], [F.asc("v")]).count() == 0
