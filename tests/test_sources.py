import json
import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarloom.operators.sequence import SegmentRules
from sonarloom.sources import audio, files, sinks
from sonarloom.streaming.segmenter import segment_batches, sessions


def test_wav_round_trip(spark, tmp_path):
    t = np.arange(4410)
    x = np.stack([0.5 * np.sin(t / 20), np.zeros(len(t))], 1)
    (tmp_path / "s").mkdir()
    audio.write_wav(str(tmp_path / "s/a_master.wav"), x, 44100)
    (tmp_path / "s/b.wav").write_bytes(b"no sound")
    found = files.listing(spark, str(tmp_path), dataset="d")
    assert [r["role"] for r in found.collect()] == ["master", "stem"]
    heads = {r["path"].rsplit("/", 1)[1]: r for r in audio.headers(found).collect()}
    assert (heads["a_master.wav"]["sr"], heads["a_master.wav"]["channels"], heads["a_master.wav"]["frames"], heads["a_master.wav"]["subtype"]) == (44100, 2, 4410, "PCM_24")
    assert heads["b.wav"]["error"]
    blocks = audio.envelope(found, 0.01, blocks_per_read=3).collect()
    got = [r["db"] for r in sorted((r for r in blocks if not r["error"]), key=lambda r: r["block"])]
    want = 20 * np.log10(np.sqrt((x[:4410, 0].reshape(-1, 441) ** 2).mean(1)))
    assert np.allclose(got, want, atol=1e-3) and sum(bool(r["error"]) for r in blocks) == 1
    path = found.filter("role = 'master'").head()["path"]
    assert np.allclose(audio.excerpt(path, 4400, 20)[:10], x[4400:], atol=1e-6) and not audio.excerpt(path, 4400, 20)[10:].any()


def test_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/c1.json").write_text(json.dumps({"music_type_info": {"instrument_cd": "SR01"}}))
    assert [tuple(r) for r in files.labels(spark, str(tmp_path / "l")).collect()] == [("c1", "SR01", None)]
    df = spark.createDataFrame([(1, math.nan)], "a int, b double")
    assert files.without_nan(df).head()["b"] is None
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("z", T.StringType())])
    assert files.pinned(df, schema).columns == ["b", "z"]
    df.write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(2,)], "a int").write.parquet(str(tmp_path / "y"))
    assert files.union_scan(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).count() == 2
    assert files.taxonomy(spark, {"i": {"stem_group": "flute", "code_71470": ""}}).head()["code_71470"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1]), (1, "a", None)], "k int, v string, l array<int>")
    base = str(tmp_path / "m/t")
    parquet, csv = sinks.write_twins(df, base, ["k"], dry_run=True)
    assert not (tmp_path / "m").exists()
    sinks.write_twins(df, base, ["k"])
    assert spark.read.parquet(parquet).count() == 2 and spark.read.csv(csv, header=True).count() == 2
    out = str(tmp_path / "out")
    assert [r["cached"] for r in sinks.append_missing(df, out, ["k"]).collect()] == [False, False]
    again = sinks.append_missing(df.unionByName(spark.createDataFrame([(3, "c", None)], df.schema)), out, ["k"])
    assert {r["k"]: r["cached"] for r in again.collect()} == {1: True, 2: True, 3: False} and spark.read.parquet(out).count() == 3
    assert sinks.to_markdown(df.select("k", "v").orderBy("k")).splitlines()[2] == "| 1 | a |"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, -50.0 if i < 4 else -240.0) for i in range(12)], "series string, block int, db double")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(segment_batches(SegmentRules(), lambda df, n: seen.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in seen] == [("s", 0, 9)]


def test_sessions(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sessions(events, "ts", "user_id").agg(F.sum("n")).head()[0] == events.count()
