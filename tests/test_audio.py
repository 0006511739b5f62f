import struct

import numpy as np
import pytest

from sonarloom.functions.loudness import integrated_loudness
from sonarloom.sources import audio, files, sinks

RATE = 8000


def tone(n, hz=440.0, channels=1, level=0.4):
    t = np.arange(n) / RATE
    return np.stack([level * np.sin(2 * np.pi * hz * t + c) for c in range(channels)], 1)


def with_leading_chunk(path, size):
    raw = path.read_bytes()
    path.write_bytes(raw[:12] + b"junk" + struct.pack("<I", size) + b"\1" * (size + size % 2) + raw[12:])


def test_any_chunks_before_the_data(spark, tmp_path):
    x = tone(1600, channels=2)
    for name, size in (("a", 1), ("b", 1 << 20)):
        audio.write_wav(str(tmp_path / f"{name}.wav"), x, RATE)
        with_leading_chunk(tmp_path / f"{name}.wav", size)
    found = files.listing(spark, str(tmp_path))
    assert {(r["frames"], r["channels"], r["error"]) for r in audio.headers(found).collect()} == {(1600, 2, "")}
    got = audio.decoded(found).collect()
    assert len(got) == 2 and all(np.allclose(np.array(r["x"]).T, x, atol=1e-6) for r in got)


def test_short_files_are_errors(spark, tmp_path):
    audio.write_wav(str(tmp_path / "cut.wav"), tone(4000), RATE)
    raw = (tmp_path / "cut.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(raw[:-3000])
    found = files.listing(spark, str(tmp_path))
    assert audio.decoded(found).head()["error"] and any(r["error"] for r in audio.envelope(found, 0.1).collect())
    assert not audio.excerpts(found.selectExpr("path", "0L as start", "100L as frames")).head()["error"]


def test_excerpts_beyond_the_end(spark, tmp_path):
    x = tone(1000)
    audio.write_wav(str(tmp_path / "a.wav"), x, RATE)
    path = str(tmp_path / "a.wav")
    rows = spark.createDataFrame([(path, 990, 20), (path, 2000, 5), (path, 500, None), ("none.wav", 0, 5)], "path string, start long, frames long")
    got = {(r["start"], r["frames"]): r for r in audio.excerpts(rows).collect()}
    assert np.allclose(got[990, 20]["x"][0], np.concatenate([x[990:, 0], np.zeros(10)]), atol=1e-6) and got[2000, 5]["x"] == [[0.0] * 5]
    assert len(got[500, None]["x"][0]) == 500 and got[0, 5]["error"]


def test_ingest_survives_a_torn_write(spark, tmp_path):
    """Half of a file at the target is written anew, not taken as done; nothing is left aside."""
    audio.write_wav(str(tmp_path / "in.wav"), tone(2000, channels=2), RATE)
    target = tmp_path / "out" / "x.wav"
    tasks = spark.createDataFrame([(str(tmp_path / "in.wav"), str(target), "pick_channel")], "src_path string, out_path string, channel_action string")
    first = audio.ingest(tasks, RATE, channel=1).head()
    assert (first["cached"], first["out_channels"], first["out_frames"]) == (False, 1, 2000)
    assert np.allclose(audio.excerpt(str(target), 0, 2000)[:, 0], tone(2000, channels=2)[:, 1] - tone(2000, channels=2)[:, 1].mean(), atol=1e-5)
    assert audio.ingest(tasks, RATE).head()["cached"]
    target.write_bytes(target.read_bytes()[:500])
    again = audio.ingest(tasks, RATE).head()
    assert not again["cached"] and not again["error"] and [p.name for p in target.parent.iterdir()] == ["x.wav"]


def test_render(spark, tmp_path):
    audio.write_wav(str(tmp_path / "a.wav"), tone(2 * RATE), RATE)
    audio.write_wav(str(tmp_path / "b.wav"), tone(2 * RATE, 700.0, 2, 0.9), RATE)
    rows = [(1, str(tmp_path / "a.wav"), 100, 0.5, False), (1, str(tmp_path / "b.wav"), 0, None, True), (2, str(tmp_path / "none.wav"), 0, 1.0, False), (3, str(tmp_path / "a.wav"), 10 * RATE, 1.0, False)]
    got = {r["item"]: r for r in audio.render(spark.createDataFrame(rows, "item int, path string, start_frame long, gain double, swapped boolean"), str(tmp_path / "out"), RATE, RATE, -23.0).collect()}
    mixture = 0.5 * np.repeat(tone(2 * RATE)[100 : 100 + RATE], 2, axis=1) + tone(2 * RATE, 700.0, 2, 0.9)[:RATE, ::-1]
    out = audio.excerpt(got[1]["path"], 0, RATE)
    assert np.allclose(out, mixture * got[1]["gain"], atol=1e-4) and integrated_loudness(out.astype(float), RATE) == pytest.approx(-23.0, abs=0.05)
    assert got[2]["error"] and got[3]["lufs"] is None and got[3]["gain"] == 1.0
    loud = {r["item"]: r for r in audio.render(spark.createDataFrame(rows[:2], "item int, path string, start_frame long, gain double, swapped boolean"), str(tmp_path / "loud"), RATE, RATE, 0.0).collect()}
    assert loud[1]["peak"] == pytest.approx(0.99)


def test_equaliser():
    x = tone(4 * RATE, 1000.0)
    level = lambda y: 20 * np.log10(np.sqrt((y[RATE:-RATE] ** 2).mean()))
    assert level(audio.equalised(x, RATE, [("peak", 1000.0, 6.0, 1.0)])) - level(x) == pytest.approx(6.0, abs=0.05)
    assert level(audio.equalised(x, RATE, [("low", 60.0, 9.0, 0.7), ("high", 3900.0, 9.0, 0.7)])) - level(x) == pytest.approx(0.0, abs=0.5)
    assert level(audio.equalised(tone(4 * RATE, 20.0), RATE, [("low", 200.0, -6.0, 0.7)])) - level(tone(4 * RATE, 20.0)) == pytest.approx(-6.0, abs=0.3)
    u = np.random.default_rng(1).random(20).tolist()
    bands = audio.random_bands(u, 5.0, 5.0, 44100)
    assert bands[0][0] == "low" and bands[-1][0] == "high" and all(abs(b[2]) <= 5 for b in bands) and len(bands) == 2 + int(u[0] * 5)


def test_folders_twins_and_reports(spark, tmp_path):
    for name in ("s1/a.wav", "s1/b.wav", "s2/c.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        audio.write_wav(str(tmp_path / name), tone(100), RATE)
    assert {r["folder"].rsplit("/", 1)[1]: r["files"] for r in files.folders(spark, str(tmp_path)).collect()} == {"s1": 2, "s2": 1}
    df = spark.createDataFrame([("x", 7200.0), ("x", 3600.0), (None, None)], "g string, s double")
    paths = sinks.write_tables({"t": df, "u": df.limit(1)}, str(tmp_path / "m"), {"t": ["g", "s"], "u": ["g"]})
    assert spark.read.parquet(paths["t"][0]).count() == 3 and paths["u"][1].endswith("m/u.csv") and "## t" in (tmp_path / "m/tables.md").read_text()
    assert sinks.summary_lines(df, ["g"], "s") == ["x: 2 files, 3.00 h", "-: 1 files, 0.00 h", "total: 3"]
    (tmp_path / "tax.json").write_text('{"i": {"stem_group": "flute", "code_71470": "A1"}, "j": {"code_71470": ""}}')
    table, codes = files.taxonomy_file(spark, str(tmp_path / "tax.json"))
    assert table.count() == 2 and codes == {"A1": "i"}
    blocks = spark.createDataFrame([(f"p{k}", i, float(i)) for k in range(3) for i in range(50)], "path string, block int, db double")
    sinks.write_envelopes(blocks, str(tmp_path / "env"))
    got = sinks.read_envelopes(spark, str(tmp_path / "env"), spark.createDataFrame([("p1", 10, 5)], "path string, first int, n int"))
    assert sorted(r["block"] for r in got.collect()) == [10, 11, 12, 13, 14]
