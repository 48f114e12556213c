"""The front end: gammatone filters, envelopes, drives and channel weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonant.functions.common import to_every_task
from resonant.plans.dims import EAR_Q, LEAST_BANDWIDTH
from resonant.session import ship


def gammatone_taps(fc: float, rate: float, order: int = 4) -> np.ndarray:
    """A finite gammatone response of 15 ms, at least 15 taps, with gain 1 at fc; finite, so it is stable at any fc."""
    width = 1.019 * (LEAST_BANDWIDTH + fc / EAR_Q)
    t = np.arange(max(15, int(rate * 0.015))) / rate
    h = t ** (order - 1) * np.exp(-2 * np.pi * width * t) * np.cos(2 * np.pi * fc * t)
    gain = abs(np.sum(h * np.exp(-2j * np.pi * fc * t)))
    return h / gain if gain > 0 else h


def analytic_taps(fc: float, rate: float, order: int = 4) -> np.ndarray:
    """The gammatone response with its quadrature as imaginary part: a causal filter whose output's magnitude is the envelope."""
    width = 1.019 * (LEAST_BANDWIDTH + fc / EAR_Q)
    t = np.arange(max(15, int(rate * 0.015))) / rate
    h = t ** (order - 1) * np.exp(-2 * np.pi * width * t) * np.exp(2j * np.pi * fc * t)
    gain = abs(np.sum(h.real * np.exp(-2j * np.pi * fc * t)))
    return h / gain if gain > 0 else h


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """The magnitude of the analytic signal."""
    n = len(x)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        keep[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * keep))


def filterbank(signal: DataFrame, channels: list[float], rate: float, envelope: bool = True) -> DataFrame:
    """track, channel, n, y of signal(track, n, x): each channel of each track is a task's work."""
    ship(signal.sparkSession)
    spread = signal.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(len(channels) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        y = np.convolve(pdf["x"].to_numpy(), gammatone_taps(channels[int(pdf["channel"].iloc[0])], rate))[: len(pdf)]
        return pd.DataFrame({"track": pdf["track"], "channel": pdf["channel"], "n": pdf["n"], "y": (analytic_envelope(y) if envelope else y).astype(np.float32)})

    return spread.groupBy("track", "channel").applyInPandas(run, "track long, channel int, n long, y float")


def fir(signal: DataFrame, taps: DataFrame) -> DataFrame:
    """channel, n, y: a causal FIR filter as a join; signal(channel, n, x), taps(lag, h) few."""
    met = signal.crossJoin(to_every_task(taps)).select("channel", (F.col("n") + F.col("lag")).alias("n"), (F.col("h") * F.col("x")).alias("part"))
    sums = met.groupBy("channel", "n").agg(F.sum("part").alias("y"))
    return sums.join(signal.select("channel", "n"), ["channel", "n"], "left_semi")


def channel_weights(channels: DataFrame, bank: DataFrame, sharpness: float = 15.0) -> DataFrame:
    """osc, channel, w: Gaussian in log frequency, each oscillator's weights sum to 1.

    An oscillator too far from every channel takes the nearest alone.
    """
    d = F.ln("f") - F.ln("fc")
    pairs = bank.join(to_every_task(channels), F.lit(True)).select("osc", "channel", F.exp(-F.pow(d * sharpness, F.lit(2))).alias("g"), F.abs(d).alias("d"))
    own = Window.partitionBy("osc")
    pairs = pairs.withColumns({"sum": F.sum("g").over(own), "near": F.row_number().over(own.orderBy("d", "channel"))})
    w = F.when(F.col("sum") < 1e-9, (F.col("near") == 1).cast("double")).otherwise(F.try_divide("g", "sum"))
    return pairs.select("osc", "channel", w.alias("w"))


def project(signal: DataFrame, weights: DataFrame) -> DataFrame:
    """osc, n, x: what each oscillator hears of signal(channel, n, x)."""
    met = signal.join(to_every_task(weights.where("w > 0")), "channel")
    return met.groupBy("osc", "n").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def decimate(drive: DataFrame, rate: float, dt: float) -> DataFrame:
    """k, drive: the sample nearest below each step, the last one beyond the end."""
    last = drive.agg(F.max("n").alias("last"))
    steps = last.select("last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") + 1) / (rate * dt)) - 1)).alias("k"))
    steps = steps.select("k", F.least(F.floor(F.col("k") * rate * dt), F.col("last")).alias("n"))
    return steps.join(drive, "n").select("k", "drive")


def running_peak(drive: DataFrame, release: float = 0.995) -> DataFrame:
    """track, n, peak: jumps up at once, falls by the release; each value needs the one before."""
    ship(drive.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        peak, out = 0.0, []
        for x in pdf["drive"]:
            peak = x if x > peak else peak * release
            out.append(peak)
        return pd.DataFrame({"track": pdf["track"], "n": pdf["n"], "peak": out})

    return drive.groupBy("track").applyInPandas(fold, "track long, n long, peak double")


def cadence(times: DataFrame, keys: list[str], hz: float, step: float) -> DataFrame:
    """keys, t of times(keys, t): the first time at or after each tick of hz, and the last time of all.

    step is the distance of the times; the last one is added only where a tick was met.
    """
    tick = F.floor(F.col("t") * hz + 1e-9)
    first = times.groupBy(*keys, tick.alias("__tick")).agg(F.min("t").alias("t")).where(F.col("t") - F.col("__tick") / hz < step)
    last = times.groupBy(*keys).agg(F.max("t").alias("t"))
    return first.select(*keys, "t").unionByName(last.join(first.select(*keys).distinct(), keys, "left_semi").select(*keys, "t")).distinct()


def snapshots(state: DataFrame, hz: float) -> DataFrame:
    """The first row of each track and oscillator in every period of 1/hz seconds; state has t."""
    rank = Window.partitionBy("track", "osc", F.floor(F.col("t") * hz)).orderBy("t")
    return state.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")
