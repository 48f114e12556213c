"""Audio to oscillator state, chunk by chunk: cochlea, drives, banks and snapshots.

An engine takes samples in chunks of any size and gives the same snapshots as over all
samples at once: filters keep their tails, drives their peaks, and banks step over
whole spans between two snapshots, for which samples wait.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from resonant.operators.dynamics import Bank
from resonant.operators.signals import analytic_taps
from resonant.plans.config import BankConfig
from resonant.session import ship


@dataclass(frozen=True)
class EngineConfig:
    rate: float  # samples a second
    channels: tuple[float, ...]  # centre frequencies of the cochlea
    pitch: tuple[float, ...]  # natural frequencies of the banks
    rhythm: tuple[float, ...]
    span: int  # samples from one snapshot to the next
    rhythm_step: int = 1  # samples from one step of the rhythm bank to the next
    sharpness: float = 15.0  # of the weights from channels to pitch oscillators
    release: float = 0.999  # of the running peak that scales the rhythm drive, for each sample
    motor: bool = False
    forward: float = 0.0
    backward: float = 0.0
    pitch_bank: BankConfig = field(default_factory=BankConfig)
    rhythm_bank: BankConfig = field(default_factory=BankConfig)


def oscillator_weights(channels: np.ndarray, bank: np.ndarray, sharpness: float) -> np.ndarray:
    """(oscillators, channels): Gaussian in log frequency, rows summing to 1; the nearest channel alone where all are too far."""
    d = np.log(bank)[:, None] - np.log(channels)[None, :]
    g = np.exp(-((d * sharpness) ** 2))
    total = g.sum(axis=1, keepdims=True)
    return np.where(total < 1e-9, np.arange(len(channels))[None, :] == np.abs(d).argmin(axis=1)[:, None], g / np.maximum(total, 1e-9))


class Engine:
    """The state of one track's engine between chunks."""

    def __init__(self, config: EngineConfig):
        self.config = config
        self.taps = [analytic_taps(f, config.rate) for f in config.channels]
        self.weights = oscillator_weights(np.array(config.channels), np.array(config.pitch), config.sharpness)
        self.tail = np.zeros(max(map(len, self.taps)) - 1)
        self.last_envelope, self.peak = None, 0.0
        self.waiting = (np.zeros((0, len(config.pitch))), np.zeros(0))
        self.banks = {"pitch": Bank(np.array(config.pitch), config.pitch_bank), "rhythm": Bank(np.array(config.rhythm), config.rhythm_bank)}
        if config.motor:
            self.banks["motor"] = Bank(np.array(config.rhythm), config.rhythm_bank)
        self.ticks = 0

    def drives(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the pitch oscillators and the rhythm bank hear of the next samples."""
        line, n = np.concatenate([self.tail, x]), len(x)
        bands = np.array([np.convolve(line, h)[len(self.tail) : len(self.tail) + n] for h in self.taps])
        self.tail = line[len(line) - len(self.tail) :]
        envelope = np.abs(bands).sum(axis=0)
        before = envelope[0] if self.last_envelope is None else self.last_envelope
        rise = np.maximum(np.diff(np.concatenate([[before], envelope])), 0.0)
        self.last_envelope = envelope[-1]
        scaled = np.empty(n)
        for k, r in enumerate(rise):
            self.peak = r if r > self.peak else self.peak * self.config.release
            scaled[k] = r / (self.peak + 1e-9)
        return (self.weights @ bands.real).T, scaled

    def process(self, x: np.ndarray) -> list[dict[str, np.ndarray]]:
        """The snapshots that the next samples complete: the state of each layer by name."""
        c = self.config
        if len(x):
            pitch, rhythm = self.drives(np.asarray(x, float))
            self.waiting = (np.concatenate([self.waiting[0], pitch]), np.concatenate([self.waiting[1], rhythm]))
        out = []
        while len(self.waiting[1]) >= c.span:
            pitch, rhythm = self.waiting[0][: c.span], self.waiting[1][: c.span]
            self.waiting = (self.waiting[0][c.span :], self.waiting[1][c.span :])
            for row in pitch:
                self.banks["pitch"].step(row)
            first = self.ticks * c.span
            heard = [float(rhythm[k]) for k in range(c.span) if (first + k) % c.rhythm_step == 0]
            held = self.banks["motor"].z if c.motor else 0.0
            for value in heard:
                self.banks["rhythm"].step(np.full(len(c.rhythm), value) + c.backward * held)
            if c.motor:
                for _ in heard:
                    self.banks["motor"].step(c.forward * self.banks["rhythm"].z)
            self.ticks += 1
            out.append({name: bank.z.copy() for name, bank in self.banks.items()})
        return out

    def saved(self) -> bytes:
        own = (self.tail, self.last_envelope, self.peak, self.waiting, self.ticks)
        return pickle.dumps((own, {name: bank.saved() for name, bank in self.banks.items()}))

    def restore(self, state: bytes) -> None:
        (self.tail, self.last_envelope, self.peak, self.waiting, self.ticks), banks = pickle.loads(state)
        for name, bank in banks.items():
            self.banks[name].restore(bank)


SNAPSHOTS = "track long, frame long, layer string, re array<double>, im array<double>"


def _rows(track: int, first: int, shots: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    rows = [(track, first + k, layer, z.real.tolist(), z.imag.tolist()) for k, shot in enumerate(shots) for layer, z in shot.items()]
    return pd.DataFrame(rows, columns=["track", "frame", "layer", "re", "im"])


def snapshots(signal: DataFrame, config: EngineConfig) -> DataFrame:
    """track, frame, layer, re, im over all samples of each track of signal(track, n, x)."""
    ship(signal.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(int(key[0]), 0, Engine(config).process(pdf.sort_values("n")["x"].to_numpy()))

    return signal.groupBy("track").applyInPandas(run, SNAPSHOTS)


def live_snapshots(chunks: DataFrame, config: EngineConfig, idle_ms: int | None = None) -> DataFrame:
    """The same from a stream of chunks(track, first, x array), with an engine for each track that goes on from chunk to chunk.

    A track without a chunk for idle_ms is forgotten and begins anew.
    """
    ship(chunks.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        engine = Engine(config)
        if state.exists:
            engine.restore(bytes(state.get[0]))
        first, shots = engine.ticks, []
        for x in pd.concat(list(parts)).sort_values("first")["x"]:
            shots += engine.process(np.asarray(x, float))
        state.update((engine.saved(),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield _rows(int(key[0]), first, shots)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("track").applyInPandasWithState(run, SNAPSHOTS, "engine binary", "append", timeout)
