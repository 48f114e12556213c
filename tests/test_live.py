import io
import os
import re
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from resonant.operators import dynamics, messages, rhythm
from resonant.plans.config import BankConfig
from resonant.plans.dims import table
from resonant.sources import files, synth
from resonant.streaming import live


def test_bank_state_goes_on_from_chunk_to_chunk(spark, tmp_path):
    x = np.random.default_rng(0).random(60)
    for k, (lo, hi) in enumerate([(0, 7), (7, 31), (31, 60)]):
        pq.write_table(pa.table({"track": pa.array([1], pa.int64()), "first": pa.array([lo], pa.int64()), "x": pa.array([x[lo:hi].tolist()])}), tmp_path / f"{k}.parquet")
    chunks = live.read_parquet_stream(spark, str(tmp_path), "track long, first long, x array<double>", 1)
    got = live.drain(live.live_bank(chunks, [0.5, 1.0], BankConfig()), "bank", str(tmp_path / "cp")).where("n = 60").orderBy("osc").collect()
    own = dynamics.Bank(np.array([0.5, 1.0]), BankConfig())
    for v in x:
        own.step(np.full(2, v))
    assert np.allclose([complex(r.re, r.im) for r in got], own.z)


@pytest.mark.parametrize("config", [BankConfig(), BankConfig(learn_rate=0.5, weight_decay=0.1, batch=3), BankConfig(delay=0.5, delay_gain=0.3), BankConfig(noise=0.05, noise_seed=4), BankConfig(learn_rate=0.5, delay=0.3, delay_gain=0.2, noise=0.02, noise_seed=7)])
def test_chunks_give_what_one_run_gives(spark, tmp_path, config):
    x = np.random.default_rng(1).random(200)
    for k in range(10):
        pq.write_table(pa.table({"track": pa.array([1], pa.int64()), "first": pa.array([20 * k], pa.int64()), "x": pa.array([x[20 * k : 20 * k + 20].tolist()])}), tmp_path / f"{k}.parquet")
        os.utime(tmp_path / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    chunks = live.read_parquet_stream(spark, str(tmp_path), "track long, first long, x array<double>", 2)
    name = "whole_" + re.sub(r"\W", "_", tmp_path.name)
    got = live.drain(live.live_bank(chunks, [0.5, 1.0, 2.0], config), name, str(tmp_path / "cp"))
    assert got.select("n").distinct().count() == 5
    own = dynamics.Bank(np.array([0.5, 1.0, 2.0]), config)
    for v in x:
        own.step(np.full(3, v))
    last = got.where("n = 200").orderBy("osc").collect()
    assert np.allclose([complex(r.re, r.im) for r in last], own.z, rtol=0, atol=1e-12)


def test_assembly_forgets_what_never_came_whole(spark, tmp_path):
    need = ["amp", "phase", "phantom", "drive", "residual"]
    rows = [(0, f, 1000 + f * 60, k, float(f)) for f in range(4) for k in need if (f, k) != (1, "drive")] + [(0, 99, 9999, "amp", 1.0)]
    df = spark.createDataFrame(rows, "track long, frame long, s long, field string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k, part in enumerate([df.where("frame < 99"), df.where("frame = 99")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.read_parquet_stream(spark, str(tmp_path / "in"), "track long, frame long, field string, value double, ts timestamp")
        writer = live.assemble(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()
    assert [(r.frame, r.amp, r.residual) for r in got] == [(f, float(f), float(f)) for f in (0, 2, 3)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # what never came whole is gone
    assert live.assemble(df).where("frame = 1").count() == 0


def test_replay_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(t, f, [float(v) for v in rng.random(32)]) for t in range(2) for f in range(13)]
    frames = spark.createDataFrame(rows, "track long, frame long, amp array<double>")
    got = live.replay(frames, f"file://{tmp_path}", batches=3)
    batch = live.tick_features(frames)
    for x, y in zip(*(df.select(batch.columns).orderBy("track", "frame").collect() for df in (got, batch)), strict=True):
        assert all(abs(p - q) < 1e-9 if isinstance(p, float) else p == q for p, q in zip(x, y))  # the order of additions
    state = frames.select("track", "frame", F.posexplode("amp").alias("osc", "amp"))
    assert sorted(got.select("track", "frame", "peak").collect()) == sorted(rhythm.peak_hysteresis(state).collect())


def test_stream_of_windows_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.read_parquet_stream(spark, str(tmp_path / "in"), "ts timestamp, k long, value double")
    got = live.drain(live.tumbling(stream, ["k"], "1 hour"), "tumbling", str(tmp_path / "cp"), "complete")
    assert sorted(got.collect()) == sorted(live.tumbling(rows, ["k"], "1 hour").collect())


def test_voices_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    amps = 0.5 + 0.4 * np.sin(np.arange(40))[:, None] * (np.arange(32) == 7) + 0.01 * rng.random((40, 32)) - 0.5 * (np.arange(32) != 7)
    for k in range(2):
        part = range(20 * k, 20 * k + 20)
        pq.write_table(pa.table({"track": pa.array([0] * 20, pa.int64()), "frame": pa.array(list(part), pa.int64()), "amp": [amps[f].tolist() for f in part], "phase": [[0.0] * 32 for _ in part]}), tmp_path / f"{k}.parquet")
    frames = live.read_parquet_stream(spark, str(tmp_path), "track long, frame long, amp array<double>, phase array<double>", 1)
    got = live.drain(live.live_voices(frames, 30), "voices", str(tmp_path / "cp")).where("active").select("voice", "frame").collect()
    assert {r.voice for r in got} == {0} and {r.frame for r in got} == set(range(7, 40))


def test_router_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "/features/key", "A"), (2, "/other", "1"), (3, "/voice/4/rhythm/phase", "0.0")], "seq long, address string, arg string").write.parquet(str(tmp_path / "in"))
    rules = table(spark, "seq, source, output, scale", [(0, "/features/key", "cv/0", "tonic_to_1v_per_oct"), (1, "/voice/*/rhythm/phase", "cv/1", "phase_to_sawtooth")])
    stream = live.read_parquet_stream(spark, str(tmp_path / "in"), "seq long, address string, arg string")
    got = live.drain(live.route_stream(stream, rules), "routed", str(tmp_path / "cp"))
    assert {(r.channel, r.value) for r in got.collect()} == {(0, 4.75), (1, 2.5)}
    assert {(r.channel, r.volts) for r in messages.held_voltages(got.withColumn("seq", F.lit(1)), 1).collect()} == {(0, 4.75)}


def test_wav_is_decoded_and_resampled(spark, tmp_path):
    t = np.arange(4800) / 48000
    x = (0.5 * np.sin(2 * np.pi * 440 * t) * 32767).astype("<i2")
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(48000)
        w.writeframes(np.repeat(x, 2).tobytes())
    (tmp_path / "tone.wav").write_bytes(buffer.getvalue())
    (row,) = files.scan_wav(spark, str(tmp_path)).collect()
    y = np.array(row.x)
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert row.track == "tone" and len(y) == 1600 and np.abs(y - want)[100:-100].max() < 0.01


def _aiff(x, width, rate, kind=b"AIFF", form=b""):
    raw = x.astype(">i2" if form != b"sowt" else "<i2").tobytes() if width == 2 else (x.astype(">i4") << 8).tobytes()
    if width == 3:
        raw = b"".join(int(v).to_bytes(3, "big", signed=True) for v in x)
    exponent, mantissa = 16383 + 63, rate
    while mantissa < 1 << 63:
        mantissa, exponent = mantissa << 1, exponent - 1
    comm = (1).to_bytes(2, "big") + len(x).to_bytes(4, "big") + (8 * width).to_bytes(2, "big") + exponent.to_bytes(2, "big") + mantissa.to_bytes(8, "big") + form
    chunk = lambda name, data: name + len(data).to_bytes(4, "big") + data + b"\0" * (len(data) % 2)
    body = kind + chunk(b"COMM", comm) + chunk(b"SSND", bytes(8) + raw)
    return b"FORM" + len(body).to_bytes(4, "big") + body


def test_other_formats_are_decoded(spark, tmp_path):
    x = (np.sin(np.arange(400) / 9) * 20000).astype(int)
    au = lambda kind, raw, channels: b".snd" + b"".join(v.to_bytes(4, "big") for v in (28, len(raw), kind, 16000, channels)) + bytes(4) + raw
    given = {
        "a.aiff": _aiff(x, 2, 16000), "b.aif": _aiff(x, 2, 16000, b"AIFC", b"sowt"), "c.AIFF": _aiff(x * 256, 3, 16000),
        "d.au": au(3, x.astype(">i2").tobytes(), 1), "e.au": au(6, np.repeat(x / 32768, 2).astype(">f4").tobytes(), 2),
        "f.raw": x.astype("<i2").tobytes(), "g.xyz": (x / 32768).astype("<f4").tobytes(), "h.txt": b"no audio",
    }
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    decoders = files.DECODERS | {"xyz": files.by_command(["cat"], 16000)}
    got = {r.track: np.array(r.x) for r in files.scan_audio(spark, str(tmp_path), decoders=decoders).collect()}
    assert sorted(got) == list("abcdefg")
    assert all(np.allclose(y, x / 32768, atol=1e-6) for y in got.values())
    for bad in (b"FORMxxxxWAVE", b"RIFF"):
        with pytest.raises(ValueError):
            files.decode_aiff(bad)
    with pytest.raises(ValueError):
        files.decode_au(b".snd" + bytes(20))


def test_state_log_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("a", 0.5, "pitch", [1.0], [0.0], [1.0], [0.0], [0.1], None, [True]), ("a", 0.1, "rhythm", [1.0], [0.0], [1.0], [0.0], [0.1], [0.2], [False])], "track string, " + files.STATE_LOG)
    files.write_state_log(log, str(tmp_path / "log"))
    files.write_state_log(log.where("layer = 'pitch'"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    got = files.scan_state_log(spark, str(tmp_path / "log"), "pitch").collect()
    assert len(got) == 1 and list(got[0].residual) == [0.0]
    plan = files.scan_state_log(spark, str(tmp_path / "log"), "pitch")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "Exchange" not in plan
    assert [r.t for r in files.scan_state_log(spark, str(tmp_path / "log"), in_order=True).collect()] == [0.1, 0.5]
    bank = files.footer_bank(spark, {b"layer.pitch.f": b"110.000000,220.000000", b"other": b"x"})
    assert [(r.osc, r.f) for r in bank.orderBy("osc").collect()] == [(0, 110.0), (1, 220.0)]


def test_generated_signals(spark):
    notes = spark.createDataFrame([(0.2, 0.5, 440.0, 1.0)], "start double, duration double, freq double, velocity double")
    x = synth.peak_normalized(synth.notes(spark, notes, 1.0, 1000)).orderBy("n").collect()
    assert len(x) == 1000 and max(abs(r.x) for r in x) == 0.8 and all(r.x == 0 for r in x[:200])
    assert synth.pulse_train(spark, 120, 1.0, 1000).where("x > 0").count() == 40
