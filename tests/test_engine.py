import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from resonant.operators import dynamics, signals
from resonant.plans.config import BankConfig
from resonant.streaming import engine, live

PLASTIC = BankConfig(dt=1 / 400, learn_rate=0.5, weight_decay=0.1, delay=0.02, delay_gain=0.1, noise=0.01, noise_seed=2)
CONFIG = engine.EngineConfig(rate=400.0, channels=(20.0, 40.0, 80.0), pitch=(20.0, 28.0, 40.0, 80.0), rhythm=(1.0, 2.0, 4.0), span=20, rhythm_step=4, motor=True, forward=0.3, backward=0.2, pitch_bank=PLASTIC, rhythm_bank=BankConfig(dt=1 / 100))


def audio(n=900):
    t = np.arange(n) / 400
    return np.sin(2 * np.pi * 40 * t) * (np.sin(2 * np.pi * 2 * t) > 0) + 0.05 * np.random.default_rng(0).standard_normal(n)


def flat(shots):
    return np.concatenate([np.concatenate([s[k] for k in sorted(s)]) for s in shots])


@pytest.mark.parametrize("sizes", [[900], [1] * 900, [7, 13, 300, 0, 580], [19, 881]])
def test_chunks_of_any_size_give_the_same(sizes):
    x, whole = audio(), engine.Engine(CONFIG).process(audio())
    assert len(whole) == 45 and set(whole[0]) == {"pitch", "rhythm", "motor"}
    own, at, shots = engine.Engine(CONFIG), 0, []
    for n in sizes:
        shots += own.process(x[at : at + n])
        again = engine.Engine(CONFIG)
        again.restore(own.saved())
        own, at = again, at + n
    assert np.allclose(flat(shots), flat(whole), rtol=0, atol=1e-10)


def test_parts_against_the_batch_operators():
    x, c = audio(), CONFIG
    own = engine.Engine(c)
    pitch, rhythm = own.drives(x)
    bands = np.array([np.convolve(x, signals.gammatone_taps(f, c.rate))[: len(x)] for f in c.channels])
    assert np.allclose(np.array([h.real for h in own.taps[:1]])[0], signals.gammatone_taps(20.0, 400.0))
    assert np.allclose(pitch, (own.weights @ bands).T) and np.allclose(own.weights.sum(axis=1), 1)
    assert rhythm.min() >= 0 and rhythm.max() <= 1
    bank = dynamics.Bank(np.array(c.pitch), PLASTIC)
    for row in pitch[:900]:
        bank.step(row)
    assert np.allclose(engine.Engine(c).process(x)[-1]["pitch"], bank.z)


def test_far_oscillators_take_the_nearest_channel():
    w = engine.oscillator_weights(np.array([100.0, 200.0]), np.array([100.0, 5000.0]), 15.0)
    assert np.allclose(w, [[1, 0], [0, 1]])


def test_stream_equals_batch(spark, tmp_path):
    x = audio()
    for k, (lo, hi) in enumerate([(0, 130), (130, 131), (131, 640), (640, 900)]):
        pq.write_table(pa.table({"track": pa.array([3], pa.int64()), "first": pa.array([lo], pa.int64()), "x": pa.array([x[lo:hi].tolist()])}), tmp_path / f"{k}.parquet")
        os.utime(tmp_path / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    chunks = live.read_parquet_stream(spark, str(tmp_path), "track long, first long, x array<double>", 1)
    name = "engine_" + re.sub(r"\W", "_", tmp_path.name)
    got = live.drain(engine.live_snapshots(chunks, CONFIG), name, str(tmp_path / "cp")).orderBy("frame", "layer").collect()
    signal = spark.createDataFrame([(3, n, float(v)) for n, v in enumerate(x)], "track long, n long, x double")
    want = engine.snapshots(signal, CONFIG).orderBy("frame", "layer").collect()
    assert [(r.track, r.frame, r.layer) for r in got] == [(r.track, r.frame, r.layer) for r in want] and len(got) == 135
    assert all(np.allclose(a.re, b.re, atol=1e-10) and np.allclose(a.im, b.im, atol=1e-10) for a, b in zip(got, want))
