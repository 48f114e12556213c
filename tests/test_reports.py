import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.operators import dynamics, messages, reports, rhythm, signals, voices
from resonant.plans.config import BankConfig
from resonant.sources import files


def slots_by_hand(rows, most, stale):
    """Updates in order; a stale voice gives its slot back, the lowest free one goes to the next that asks."""
    out, last, held, begun = [], {}, {}, {}
    for frame, voice in sorted(rows):
        for v in [v for v, at in last.items() if at < frame - stale]:
            last.pop(v), begun.pop(v), held.pop(v, None)
        last[voice] = frame
        begun.setdefault(voice, frame)
        free = [s for s in range(most) if s not in held.values()]
        if voice not in held and free:
            held[voice] = free[0]
        out.append((frame, voice, held.get(voice), begun[voice]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_slots_are_freed_and_taken_again(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(120), rng.randrange(9)) for _ in range(250)})
    df = spark.createDataFrame([(t, f, v, 1.0, 1.0) for t in (0, 1) for f, v in rows], "track long, frame long, voice long, freq double, amp double")
    want = slots_by_hand(rows, 3, 4)
    for t in (0, 1):
        got = reports.voice_slots(df, 3, 4).where(F.col("track") == t).select("frame", "voice", "slot", "begun").collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
    assert len({v for _, v, s, _ in want if s == 0}) > 1  # a slot has had several voices
    assert None in {s for *_, s, _ in want}


def test_a_voice_takes_the_lowest_free_slot(spark):
    rows = [(0, 1), (0, 2), (1, 2), (9, 2), (9, 3), (10, 1)]
    df = spark.createDataFrame([(0, f, v) for f, v in rows], "track long, frame long, voice long")
    assert [(r.frame, r.voice, r.slot) for r in reports.voice_slots(df, 2, 5).orderBy("frame", "voice").collect()] == [(0, 1, 0), (0, 2, 1), (1, 2, 1), (9, 2, 0), (9, 3, 1), (10, 1, None)]


def test_weights_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "w")
    assert files.scan_weights(spark, path).collect() == []
    w = spark.createDataFrame([("a", "pitch", 0.5, 0, 1, 1.0, 0.0), ("a", "pitch", 1.0, 0, 1, 2.0, 0.0), ("b", "rhythm", 1.0, 0, 1, 3.0, 0.0)], "track string, layer string, t double, i int, j int, re double, im double")
    files.write_weights(w, path)
    files.write_weights(w.where("track = 'b'").withColumn("re", F.lit(4.0)), path)
    assert sorted((r.track, r.t, r.re) for r in files.scan_weights(spark, path).collect()) == [("a", 0.5, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 4.0)]
    assert [(r.track, r.re) for r in files.final_weights(files.scan_weights(spark, path, "pitch")).collect()] == [("a", 2.0)]


def test_cadence_has_the_last_time(spark):
    times = spark.createDataFrame([(0, k / 10) for k in range(8)], "track long, t double")
    assert sorted(r.t for r in signals.cadence(times, ["track"], 2.0, 0.1).collect()) == [0.0, 0.5, 0.7]


def test_clock_and_notes(spark):
    tempos = spark.createDataFrame([(0, 1.0, 2.0, 120.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 1.0, None)], "k long, start double, end double, bpm double")
    got = messages.clock_messages(tempos, ["k"]).orderBy("tick").collect()
    assert len(got) == 48 and {r.k for r in got} == {0} and got[0]["at"] == 1.0 and got[47]["at"] < 2.0
    chords = spark.createDataFrame([(0, 0, [0, 4, 7]), (0, 1, [0, 4, 7]), (0, 2, [0, 3, 7]), (0, 3, None)], "k long, seq long, notes array<int>")
    events = [(r.seq, r.type, r.note) for r in messages.chord_notes(chords, ["k"]).orderBy("seq", "place").collect()]
    assert events == [(0, "note_on", 60), (0, "note_on", 64), (0, "note_on", 67), (2, "note_off", 64), (2, "note_on", 63), (3, "note_off", 60), (3, "note_off", 63), (3, "note_off", 67)]


def test_rhythm_messages_of_a_peak_alone(spark):
    peaks = spark.createDataFrame([(0, 5, 2.0, 120.0, 0.5)], "track long, osc int, f double, bpm double, phase double")
    none = spark.createDataFrame([], "track long, seq int, p int, q int, osc int, f double, phase double, plv double")
    got = {r.address: r.arg for r in messages.rhythm_messages(peaks, none, ["track"]).collect()}
    assert got == {"/rhythm/peak/freq": "2.0", "/rhythm/peak/bpm": "120.0", "/rhythm/peak/phase": "0.5", "/rhythm/peak/idx": "5", "/rhythm/companion/count": "0"}


def test_the_last_peak_is_kept_while_strong(spark):
    rng = np.random.default_rng(0)
    rows = [(0, f, o, float(0.1 + 0.5 * (o == 9) + 0.45 * (o == 20)), float(rng.random())) for f in range(5) for o in range(32)]
    state = spark.createDataFrame(rows, "track long, frame long, osc int, amp double, phase double")
    before = lambda o: spark.createDataFrame([(0, o)], "track long, osc int")
    assert rhythm.structure(spark, state, ["track"])[0].first().osc == 9
    assert rhythm.structure(spark, state, ["track"], before(20))[0].first().osc == 20
    assert rhythm.structure(spark, state, ["track"], before(3))[0].first().osc == 9


def test_motor_in_batches(spark):
    drive = spark.createDataFrame([(0, n, float(np.sin(n))) for n in range(30)], "track long, n long, drive double")
    run = lambda batch: {(r.layer, r.frame, r.osc): (r.re, r.im) for r in dynamics.simulate_coupled(drive, [0.5, 1.0], BankConfig(), 0.4, 0.2, batch=batch).collect()}
    one, eight = run(1), run(8)
    assert set(one) == set(eight) and one != eight
    rhythm_bank, motor_bank = dynamics.Bank(np.array([0.5, 1.0]), BankConfig()), dynamics.Bank(np.array([0.5, 1.0]), BankConfig())
    for lo in range(0, 30, 8):
        held, part = motor_bank.z, range(lo, min(lo + 8, 30))
        for n in part:
            rhythm_bank.step(np.sin(n) + 0.2 * held)
        for _ in part:
            motor_bank.step(0.4 * rhythm_bank.z)
    assert np.allclose([complex(*eight["motor", 29, o]) for o in (0, 1)], motor_bank.z) and np.allclose([complex(*eight["rhythm", 29, o]) for o in (0, 1)], rhythm_bank.z)


def test_slower_clock(spark):
    drive = spark.createDataFrame([(0, n, float(n)) for n in range(20)], "track long, n long, drive double")
    assert [(r.n, r.drive) for r in dynamics.clocked(drive, 10.0, 0.3).orderBy("n").collect()] == [(0, 0.0), (1, 3.0), (2, 6.0), (3, 9.0), (4, 12.0), (5, 15.0), (6, 18.0)]


def test_missing_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert [r.k for r in reports.missing(a, b).collect()] == [1] and reports.missing(b.where("k = 2"), a).isEmpty()


def test_tracked_voices_have_their_banks(spark):
    rng = np.random.default_rng(4)
    hz, half, frames = 20.0, 20, 60
    t = np.arange(frames) / hz
    amps = 0.01 * rng.random((frames, 32))
    amps[:, 5] += 0.5 + 0.4 * np.sin(2 * np.pi * 2.0 * t)
    amps[:, 20] += 0.5 + 0.4 * np.sin(2 * np.pi * 3.2 * t + 1)
    phases = rng.uniform(-3, 3, (frames, 32))
    state = spark.createDataFrame([(0, f, o, float(amps[f, o]), float(phases[f, o])) for f in range(frames) for o in range(32)], "track long, frame long, osc int, amp double, phase double")
    bank = np.geomspace(0.5, 10, 32)
    found = voices.track_voices(state, half, 10)
    both = voices.tracked_banks(found, state, {"rhythm": state, "motor": state.withColumn("phase", -F.col("phase"))}, spark.createDataFrame([(o, float(f)) for o, f in enumerate(bank)], "osc int, f double"), half, hz)
    rows = both.where("active").collect()
    assert both.count() == found.count() and len({r.voice for r in rows}) >= 2
    for r in rows:
        lo, hi = max(0, r.frame - half), min(frames, r.frame + half + 1)
        env = amps[lo:hi][:, list(r.members)].mean(axis=1)
        x = env - env.mean()
        power = [abs((x * np.exp(-2j * np.pi * f * np.arange(len(x)) / hz)).mean()) if 1 <= f <= 4 else -1 for f in bank]
        best = int(np.argmax(power))
        assert r.rhythm.osc == best and abs(r.rhythm.bpm - 60 * bank[best]) < 1e-9
        assert abs(r.rhythm.phase - phases[hi - 1, best]) < 1e-12 and abs(r.motor.phase + phases[hi - 1, best]) < 1e-12
    sent = {x.address for x in messages.voice_messages(both).collect()}
    assert {f"/voice/{rows[0].voice}/{b}/{k}" for b in ("rhythm", "motor") for k in ("freq", "bpm", "phase", "osc_idx", "confidence")} <= sent


def test_osc_packets(spark):
    given = [("/voice/1/amp", [0.5]), ("/features/key", ["C#"]), ("/a", []), ("/list", [1, 2, 3])]
    packets = [files.osc_packet(a, args) for a, args in given]
    assert [files.osc_messages(p) for p in packets] == [[("/voice/1/amp", ["0.5"])], [("/features/key", ["C#"])], [("/a", [])], [("/list", ["1", "2", "3"])]]
    bundle = b"#bundle\0" + bytes(8) + b"".join(len(p).to_bytes(4, "big") + p for p in packets)
    assert len(files.osc_messages(bundle)) == 4
    assert [files.osc_messages(p) for p in (b"", b"/x", packets[0][:-2], b"no\0\0,\0\0\0")] == [[]] * 4
    df = spark.createDataFrame([(0, packets[0]), (1, bundle), (2, None), (3, b"junk")], "seq long, packet binary")
    got = [tuple(r) for r in files.decode_packets(df).collect()]
    assert got == [(0, "/voice/1/amp", "0.5"), (1, "/voice/1/amp", "0.5"), (1, "/features/key", "C#"), (1, "/a", ""), (1, "/list", "1")]
