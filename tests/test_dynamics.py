import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.operators import dynamics, signals
from resonant.plans import config, dims
from resonant.plans.config import BankConfig, OscillatorParams


def run(bank, x, n):
    for k in range(n):
        bank.step(np.full(len(bank.f), x(k)))
    return bank


def test_damped_oscillator_decays():
    bank = dynamics.Bank(np.array([2.0]), BankConfig(dt=0.002))
    before = abs(bank.z[0])
    assert abs(run(bank, lambda k: 0.0, 5000).z[0]) < before / 2


def test_limit_cycle_amplitude():
    p = OscillatorParams(alpha=0.2, beta1=-1.0, beta2=-1.0)
    bank = run(dynamics.Bank(np.array([2.0]), BankConfig(params=p, dt=0.002)), lambda k: 0.0, 40000)
    assert abs(bank.z[0]) == pytest.approx((0.2 / 1.2) ** 0.5, rel=0.2)


def test_resonance_and_cut():
    dt = 0.002
    drive = lambda k: 0.3 * np.cos(2 * np.pi * 2.0 * k * dt)
    bank = run(dynamics.Bank(np.array([2.0, 5.0]), BankConfig(dt=dt)), drive, 10000)
    assert abs(bank.z[0]) > 3 * abs(bank.z[1])
    hard = run(dynamics.Bank(np.array([2.0]), BankConfig(dt=dt)), lambda k: 1e4, 50)
    assert abs(hard.z[0]) <= 0.98 + 1e-9


def test_weights_grow_stay_hollow_and_decay():
    c = BankConfig(dt=0.01, learn_rate=1.0)
    bank = run(dynamics.Bank(np.array([1.0, 2.0, 3.0]), c), lambda k: 0.5, 200)
    assert np.abs(bank.weights).max() > 1e-4 and not np.diag(bank.weights).any()
    fading = dynamics.Bank(np.array([1.0, 2.0]), BankConfig(dt=0.01, weight_decay=1.0))
    fading.weights = np.array([[0, 1], [1, 0]], complex)
    fading.z[:] = 0
    assert np.abs(run(fading, lambda k: 0.0, 100).weights).max() < 0.5


def test_delay_and_noise_are_reproducible():
    c = BankConfig(delay=0.5, delay_gain=0.3, noise=0.1, noise_seed=4)
    a, b = (run(dynamics.Bank(np.array([1.0, 2.0]), c), lambda k: 0.1, 50).z for _ in range(2))
    assert (a == b).all() and len(dynamics.Bank(np.array([1.0]), c).ring) == 12
    assert (a != run(dynamics.Bank(np.array([1.0, 2.0]), BankConfig(delay=0.5, delay_gain=0.3)), lambda k: 0.1, 50).z).all()


def test_fold_in_spark_equals_bank(spark):
    f = [0.5, 1.0, 2.0]
    x = [0.0, 0.3, 1.0, 0.2, 0.0, 0.7] * 10
    drive = spark.createDataFrame([(n, v) for n, v in enumerate(x)], "n long, drive double")
    bank = spark.createDataFrame([(k, v) for k, v in enumerate(f)], "osc int, f double")
    got = {r.osc: complex(r.re, r.im) for r in dynamics.drive_bank(drive, bank, 1 / 24, OscillatorParams()).collect()}
    own = dynamics.Bank(np.array(f), BankConfig())
    own.z[:] = 1e-3
    for v in x:
        own.step(np.full(3, v))
    assert np.allclose([got[k] for k in range(3)], own.z, atol=1e-9)


def test_coupled_layers(spark):
    drive = spark.createDataFrame([(0, n, float(n < 60 and n % 12 == 0)) for n in range(240)], "track long, n long, drive double")
    out = dynamics.simulate_coupled(drive, [1.0, 2.0], BankConfig(), 0.4, 0.2, 10)
    rows = {(r.layer, r.frame): r.n for r in out.groupBy("layer", "frame").agg(F.count("*").alias("n")).collect()}
    assert len(rows) == 48 and set(rows.values()) == {2}


@pytest.mark.parametrize("fc", [30.0, 440.0, 4000.0])
def test_gammatone_gain_is_one_at_its_centre(fc):
    h = signals.gammatone_taps(fc, 16000.0)
    t = np.arange(len(h)) / 16000.0
    assert abs(np.sum(h * np.exp(-2j * np.pi * fc * t))) == pytest.approx(1.0)


def test_envelope_of_a_tone_is_flat():
    x = np.sin(2 * np.pi * 50 * np.arange(1000) / 1000)
    assert np.allclose(signals.analytic_envelope(x)[50:-50], 1, atol=1e-6)


def test_tempered_grid_size_and_errors(spark):
    assert dims.tempered_bank(spark, 40.0, 12500.0, 2).count() > 100
    with pytest.raises(ValueError):
        dims.tempered_bank(spark, 100.0, 50.0)


def test_toml_configuration():
    c = config.bank_from_toml("[pitch]\ndt = 0.1\n[pitch.params]\nalpha = -0.3\n", "pitch")
    assert c.dt == 0.1 and c.params.alpha == -0.3
    with pytest.raises(ValueError):
        config.bank_from_toml("[pitch]\nunknown = 1\n", "pitch")
    assert config.rules_from_toml('[[mapping]]\nsource = "/a"\noutput = "cv/0"\n')[0].scale == "passthrough"
