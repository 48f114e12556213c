"""Driven nonlinear oscillators.

Uncoupled oscillators fold over an array of drive values inside Catalyst. Coupling,
delay, noise and plasticity make a bank's oscillators depend on each other, so a
bank steps in time as NumPy vectors, one task for each track and layer.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonant.functions.common import cx, cx_abs2, cx_add, let
from resonant.plans.config import BankConfig, OscillatorParams
from resonant.session import ship


def growth(z: Column, x: Column, omega: Column, p: OscillatorParams) -> Column:
    """The rate of change of struct<re, im> z under the input x."""

    def at(m: Column) -> Column:
        s = F.least(m, F.lit(0.95 / max(p.epsilon, 1e-9)))
        high = p.epsilon * s * s / (1 - p.epsilon * s)
        gain = p.alpha + p.beta1 * m + p.beta2 * high
        turn = omega + p.delta1 * m + p.delta2 * high
        return cx(z["re"] * gain - z["im"] * turn + x["re"], z["re"] * turn + z["im"] * gain + x["im"])

    return let(cx_abs2(z), at)


def rk4(z: Column, x: Column, omega: Column, dt: float, p: OscillatorParams) -> Column:
    """One Runge-Kutta step with the input held, then the cut at the largest amplitude."""
    f = lambda y: growth(y, x, omega, p)

    def done(k1: Column, k2: Column, k3: Column, k4: Column) -> Column:
        mean = lambda c: (k1[c] + 2 * k2[c] + 2 * k3[c] + k4[c]) * (dt / 6)
        return cut(cx(z["re"] + mean("re"), z["im"] + mean("im")), p)

    return let(f(z), lambda k1: let(f(cx_add(z, k1, dt / 2)), lambda k2: let(f(cx_add(z, k2, dt / 2)), lambda k3: let(f(cx_add(z, k3, dt)), lambda k4: done(k1, k2, k3, k4)))))


def cut(z: Column, p: OscillatorParams) -> Column:
    def at(y: Column) -> Column:
        m = F.sqrt(cx_abs2(y))
        scale = F.when(m > p.limit, p.limit / m).otherwise(1.0)
        return cx(y["re"] * scale, y["im"] * scale)

    return let(z, at)


def drive_bank(drive: DataFrame, bank: DataFrame, dt: float, p: OscillatorParams, start: float = 1e-3) -> DataFrame:
    """osc, re, im, top: where each oscillator of bank(osc, f) ends under drive(n, drive), and its largest amplitude.

    The drive is an array that goes to each oscillator's row; the fold stays in the JVM.
    """
    line = drive.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "drive"))), lambda s: s["drive"]).alias("line"))
    omega = 2 * math.pi * F.col("f")
    zero = F.struct(F.lit(start).alias("re"), F.lit(0.0).alias("im"), F.lit(start).alias("top"))

    def step(s: Column, x: Column) -> Column:
        after = rk4(cx(s["re"], s["im"]), cx(x * p.input_gain, F.lit(0.0)), omega, dt, p)
        return let(after, lambda z: F.struct(z["re"].alias("re"), z["im"].alias("im"), F.greatest(s["top"], F.sqrt(cx_abs2(z))).alias("top")))

    ends = bank.crossJoin(line).select("osc", F.aggregate("line", zero, step).alias("z"))
    return ends.select("osc", "z.re", "z.im", "z.top")


def hebbian(state: DataFrame, weights: DataFrame, dt: float, rate: float, decay: float) -> DataFrame:
    """weights(track, i, j, re, im) after one step on state(track, osc, re, im); the diagonal stays 0."""
    a = state.select("track", F.col("osc").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = state.select("track", F.col("osc").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, "track").where("i <> j").join(weights, ["track", "i", "j"], "left")
    old = {c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")}
    real = F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")
    imag = F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")
    return pairs.select("track", "i", "j", (old["re"] + dt * (rate * real - decay * old["re"])).alias("re"), (old["im"] + dt * (rate * imag - decay * old["im"])).alias("im"))


def mean_field(state: DataFrame, weights: DataFrame) -> DataFrame:
    """track, osc, re, im: W z / n."""
    n = state.groupBy("track").agg(F.countDistinct("osc").alias("n"))
    met = weights.select("track", F.col("i").alias("target"), F.col("j").alias("osc"), F.col("re").alias("wr"), F.col("im").alias("wi")).join(state, ["track", "osc"])
    real, imag = F.col("wr") * F.col("re") - F.col("wi") * F.col("im"), F.col("wr") * F.col("im") + F.col("wi") * F.col("re")
    sums = met.groupBy("track", "target").agg(F.sum(real).alias("re"), F.sum(imag).alias("im"))
    return sums.join(n, "track").select("track", F.col("target").alias("osc"), (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def phantom(amp: Column, drive: Column, least_amp: float = 0.1, most_drive: float = 0.02) -> Column:
    """Resonating without being driven."""
    return (amp > least_amp) & (drive < most_drive)


def blended(phantom: Column, surprise: Column, most: float, paper: str, ink: str, flash: str, cover: float = 0.85) -> Column:
    """struct<r, g, b> of a strip's cell: ink over the paper where it resonates undriven, then the flash as strong as the positive surprise.

    Colours are six hexadecimal digits.
    """
    rgb = lambda s: [int(s.lstrip("#")[k : k + 2], 16) / 255 for k in (0, 2, 4)]
    on = phantom.cast("double") * cover
    share = F.least(F.lit(1.0), F.greatest(surprise, F.lit(0.0)) / max(most, 1e-9))
    parts = [(f * share + (i * on + p * (1 - on)) * (1 - share)).alias(c) for c, p, i, f in zip("rgb", rgb(paper), rgb(ink), rgb(flash))]
    return F.struct(*parts)


def residual(drive: Column, amp: Column, p: OscillatorParams) -> Column:
    """What the drive is beyond what holds the amplitude against damping."""
    return F.abs(drive * p.input_gain) - abs(p.alpha) * amp


def clocked(drive: DataFrame, sample_rate: float, step: float) -> DataFrame:
    """track, n, drive of a slower bank: its k-th step takes the sample at which k * step seconds are reached.

    Layers that do not hear each other run at their own rates as separate folds over
    drives of their own.
    """
    at = F.floor(F.col("n") / sample_rate / step + 1e-9)
    before = F.floor((F.col("n") - 1) / sample_rate / step + 1e-9)
    return drive.where(at > before).select("track", at.cast("long").alias("n"), "drive")


# --- coupled banks ---------------------------------------------------------------------------


@dataclass
class Bank:
    """A bank's state between steps; all vectors run over its oscillators."""

    f: np.ndarray
    config: BankConfig

    def __post_init__(self) -> None:
        n, c = len(self.f), self.config
        rng = np.random.default_rng(0)
        self.z = 1e-3 * (rng.standard_normal(n) + 1j * rng.standard_normal(n))
        self.omega = 2 * np.pi * np.asarray(self.f, float)
        self.plastic = c.learn_rate != 0 or c.weight_decay != 0
        self.weights = np.zeros((n, n), complex) if self.plastic else None
        self.ring = np.zeros((max(1, round(c.delay / c.dt)), n), complex) if c.delay > 0 else None
        self.noise = np.random.default_rng(c.noise_seed)
        self.at, self.count = 0, 0
        self.heard = np.zeros(n, complex)
        p = c.params
        real = lambda a, b: complex(a, b) if b else a  # noqa: E731  real factors cost less
        self._turn, self._first, self._second = p.alpha + 1j * self.omega, real(p.beta1, p.delta1), real(p.beta2, p.delta2)
        self._most = 0.95 / max(p.epsilon, 1e-9)

    @property
    def input(self) -> np.ndarray:
        """The magnitude of what the oscillators heard last."""
        return np.abs(self.heard)

    @property
    def surprise(self) -> np.ndarray:
        """What that was beyond what holds the amplitudes against damping."""
        return self.input - abs(self.config.params.alpha) * np.abs(self.z)

    def saved(self) -> bytes:
        """All that changes from step to step: state, weights, delay ring, noise generator and counts."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k not in ("f", "config", "omega", "plastic") and k[0] != "_"})

    def restore(self, state: bytes) -> None:
        vars(self).update(pickle.loads(state))

    def _rate(self, z: np.ndarray, held: np.ndarray) -> np.ndarray:
        re, im = z.real, z.imag
        m = re * re + im * im
        s = np.minimum(m, self._most)
        e = self.config.params.epsilon * s
        return z * (self._turn + (self._first * m + self._second * (s * e / (1 - e)))) + held

    def step(self, x: np.ndarray) -> np.ndarray:
        c, p = self.config, self.config.params
        held = self.heard = np.asarray(x, complex) * p.input_gain
        if self.weights is not None:
            held = held + self.weights @ self.z / len(self.z)
        if self.ring is not None:
            held = held + c.delay_gain * self.ring[self.at]
        z, half = self.z, c.dt / 2
        k1 = self._rate(z, held)
        k2 = self._rate(z + half * k1, held)
        k3 = self._rate(z + half * k2, held)
        k4 = self._rate(z + c.dt * k3, held)
        k2 += k3
        k2 += k2
        k2 += k1
        k2 += k4
        z = z + c.dt / 6 * k2
        if c.noise > 0:
            re = self.noise.standard_normal(len(z))
            z = z + c.noise * math.sqrt(c.dt) * (re + 1j * self.noise.standard_normal(len(z)))
        m = np.abs(z)
        if m.max() > p.limit:
            z = np.where(m > p.limit, z * (p.limit / np.maximum(m, p.limit)), z)
        self.z = z
        self.count += 1
        if self.weights is not None and self.count % c.batch == 0:
            self.weights = self.weights + c.dt * (c.learn_rate * np.outer(self.z, self.z.conj()) - c.weight_decay * self.weights)
            np.fill_diagonal(self.weights, 0)
        if self.ring is not None:
            self.ring[self.at] = self.z
            self.at = (self.at + 1) % len(self.ring)
        return self.z


STATE = "track long, frame long, osc int, re double, im double, drive double, residual double"


def _snapshot(track: int, frame: int, bank: Bank) -> pd.DataFrame:
    return pd.DataFrame({"track": track, "frame": frame, "osc": np.arange(len(bank.f), dtype=np.int32), "re": bank.z.real, "im": bank.z.imag, "drive": bank.input, "residual": bank.surprise})


def simulate(drive: DataFrame, f: list[float], config: BankConfig, every: int = 1) -> DataFrame:
    """Snapshots of a bank on each track of drive(track, n, drive), one every `every` samples."""
    ship(drive.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bank, out = Bank(np.array(f), config), []
        for k, x in enumerate(pdf.sort_values("n")["drive"].to_numpy()):
            bank.step(np.full(len(f), x))
            if k % every == 0:
                out.append(_snapshot(pdf["track"].iloc[0], k // every, bank))
        return pd.concat(out)

    return drive.groupBy("track").applyInPandas(run, STATE)


def simulate_coupled(drive: DataFrame, f: list[float], config: BankConfig, forward: float, backward: float, every: int = 1, batch: int = 1) -> DataFrame:
    """As simulate, with a motor bank in lockstep: layer is rhythm or motor.

    The rhythm bank hears the drive and the motor bank's last state, the motor bank
    the rhythm bank's new one. With `batch`, as on the live path, the motor's state is
    held while the rhythm bank takes that many samples, and the rhythm bank's last
    state while the motor bank takes as many.
    """
    ship(drive.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rhythm, motor, out = Bank(np.array(f), config), Bank(np.array(f), config), []
        line = pdf.sort_values("n")["drive"].to_numpy()
        for lo in range(0, len(line), batch):
            samples, shots, held = range(lo, min(lo + batch, len(line))), {}, motor.z
            for k in samples:
                rhythm.step(line[k] + backward * held)
                if k % every == 0:
                    shots["rhythm", k] = _snapshot(pdf["track"].iloc[0], k // every, rhythm)
            for k in samples:
                motor.step(forward * rhythm.z)
                if k % every == 0:
                    shots["motor", k] = _snapshot(pdf["track"].iloc[0], k // every, motor)
            out += [s.assign(layer=layer) for (layer, _), s in shots.items()]
        return pd.concat(out)

    return drive.groupBy("track").applyInPandas(run, STATE + ", layer string")
