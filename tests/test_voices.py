import itertools

import numpy as np
import pytest

from resonant.operators import voices
from resonant.operators.voices import Tracker, Voice, assignment, window_voices
from resonant.plans.config import VoiceConfig

F32 = 110.0 * 2 ** (np.arange(32) / 12)
RNG = np.random.default_rng(42)


def window(groups, frames=120):
    """Amplitudes with an envelope of its own for each group of oscillators."""
    t = np.arange(frames) / 60
    amps = 0.003 * RNG.random((frames, 32))
    for k, group in enumerate(groups):
        env = 0.5 + 0.4 * np.sin(2 * np.pi * (1.3 + 0.9 * k) * t + k)
        for o in group:
            amps[:, o] += env * (1 + 0.03 * RNG.standard_normal(frames))
    return amps


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)])
def test_assignment_is_cheapest(shape):
    for _ in range(20):
        cost = RNG.integers(0, 20, shape).astype(float)
        got = assignment(cost)
        used = [c for c in got if c >= 0]
        assert len(set(used)) == len(used) == min(shape)
        value = sum(cost[r, c] for r, c in enumerate(got) if c >= 0)
        small, large = (cost, shape) if shape[0] <= shape[1] else (cost.T, shape[::-1])
        assert value == min(sum(small[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(large[1]), large[0]))


def test_silence_and_single_frame_give_nothing():
    c = VoiceConfig()
    assert window_voices(np.zeros((20, 32)), np.zeros(32), F32, c) == []
    assert window_voices(np.ones((1, 32)), np.zeros(32), F32, c) == []


def test_two_envelopes_are_two_voices():
    found = window_voices(window([[3, 4], [20]]), np.zeros(32), F32, VoiceConfig())
    assert sorted(sorted(v.members) for v in found) == [[3, 4], [20]]


def test_identity_persists_retires_and_is_not_reused():
    c = VoiceConfig(most_silent=3)
    t = Tracker(c)
    first = window_voices(window([[5]]), np.zeros(32), F32, c)
    assert [v.id for v in t.advance(first)] == [0]
    assert [(v.id, v.age) for v in t.advance(first)] == [(0, 1)]
    assert [(v.active, v.silent) for v in t.advance([])] == [(False, 1)]
    for _ in range(3):
        t.advance([])
    assert t.voices == []
    assert [v.id for v in t.advance(first)] == [1]


def test_far_cluster_is_a_new_voice():
    t = Tracker()
    t.advance([Voice(-1, frozenset([1]), 110.0, 0.5, 0.0, 1.0)])
    now = t.advance([Voice(-1, frozenset([30]), 600.0, 0.5, 0.0, 1.0)])
    assert [(v.id, v.active) for v in now] == [(1, True), (0, False)]


def test_clusters_in_spark_equal_the_window_function(spark):
    amps = window([[2, 14], [9], [21, 22]], 40)
    rows = [(0, f, o, float(amps[f, o]), 0.0) for f in range(40) for o in range(32)]
    state = spark.createDataFrame(rows, "track long, frame long, osc int, amp double, phase double")
    got = {}
    for r in voices.clusters(state, ["track"]).collect():
        got.setdefault(r.cluster, set()).add(r.osc)
    want = {min(v.members): set(v.members) for v in window_voices(amps, np.zeros(32), F32, VoiceConfig())}
    assert got == want


def test_match_is_kept_by_silent_voices_only(spark):
    v = spark.createDataFrame([(0, 0, 1, True), (0, 1, 1, False), (0, 2, 1, True)], "track long, frame long, voice long, active boolean")
    m = spark.createDataFrame([(0, 0, 1, 5, 120.0, 0.9)], "track long, frame long, voice long, osc int, bpm double, confidence double")
    got = {r.frame: r.rhythm for r in voices.with_bank_match(v, m, "rhythm").collect()}
    assert got[0].osc == 5 and got[1].osc == 5 and got[2] is None
