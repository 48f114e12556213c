"""Rhythm structure: the peak, its companions, and the peak's hysteresis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.functions.common import first_of_largest, vector_length
from resonant.functions.music import tempo_prior
from resonant.operators.rollups import mean_amp
from resonant.plans.dims import COMPANION_RATIOS, N_OSC, RHYTHM_LOW, RHYTHM_SPAN, banks, ratios, rhythm_frequency
from resonant.session import ship


def biased_peak(amps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, peak, top: the oscillator with the largest amplitude under the tempo prior, and the largest amplitude."""
    biased = F.col("amp") * tempo_prior(rhythm_frequency(F.col("osc")))
    return amps.groupBy(*keys).agg(first_of_largest(biased, F.col("osc")).alias("peak"), F.max("amp").alias("top"))


def companions(spark: SparkSession, state: DataFrame, keys: list[str], least_plv: float = 0.7, least_amp: float = 0.3, peaks: DataFrame | None = None) -> DataFrame:
    """keys, seq, p, q, osc, f, phase, plv of the oscillators locked to the peak.

    For each ratio the oscillator nearest to the peak's frequency times p/q competes,
    if the bank reaches that far and it is not the peak. Windows need four frames.
    """
    amps = mean_amp(state, keys)
    if peaks is None:
        peaks = biased_peak(amps, keys)
    bank = banks(spark).select(F.col("osc").alias("cand"), F.col("rhythm_f").alias("cand_f"))
    aims = peaks.crossJoin(F.broadcast(ratios(spark, COMPANION_RATIOS)))
    aims = aims.withColumn("aim", rhythm_frequency(F.col("peak")) * F.col("p") / F.col("q")).where(F.col("aim").between(RHYTHM_LOW, RHYTHM_LOW * RHYTHM_SPAN))
    near = aims.crossJoin(F.broadcast(bank)).groupBy(*keys, "seq", "p", "q", "peak", "top").agg(F.min_by("cand", F.struct(F.abs(F.col("cand_f") - F.col("aim")), "cand")).alias("osc"))
    near = near.where("osc <> peak").join(amps, [*keys, "osc"]).where(F.col("amp") >= least_amp * F.col("top"))
    phases = state.select(*keys, "frame", "osc", "phase")
    own = phases.select(*keys, "frame", F.col("osc").alias("peak"), F.col("phase").alias("peak_phase"))
    met = near.join(phases, [*keys, "osc"]).join(own, [*keys, "peak", "frame"])
    turn = F.col("p") * F.col("peak_phase") - F.col("q") * F.col("phase")
    found = met.groupBy(*keys, "seq", "p", "q", "osc").agg(
        F.count("*").alias("n"), vector_length(F.avg(F.cos(turn)), F.avg(F.sin(turn))).alias("plv"), F.max_by("phase", "frame").alias("phase")
    )
    found = found.where((F.col("n") >= 4) & (F.col("plv") >= least_plv))
    return found.select(*keys, "seq", "p", "q", "osc", rhythm_frequency(F.col("osc")).alias("f"), "phase", "plv")


def rhythm_prior(osc: np.ndarray) -> np.ndarray:
    """The tempo prior of the rhythm bank's oscillators."""
    return np.exp(-0.5 * np.log2(RHYTHM_LOW * RHYTHM_SPAN ** (osc / (N_OSC - 1)) / 2.0) ** 2)


def next_peak(amp: np.ndarray, last: int, keep: float = 0.8) -> int:
    """The peak of a frame of the whole bank, given that of the frame before, -1 if there is none."""
    if last < 0 or amp[last] < keep * amp.max():
        return int((amp * rhythm_prior(np.arange(len(amp)))).argmax())
    return last


def structure(spark: SparkSession, state: DataFrame, keys: list[str], before: DataFrame | None = None, keep: float = 0.8, least_plv: float = 0.7, least_amp: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(peaks, companions): keys, osc, f, bpm, phase of the peak, and the oscillators locked to it.

    before(keys, osc) is the peak that each window had last; it stays while it has
    `keep` of the largest amplitude. Phases are those of the window's last frame.
    """
    amps = mean_amp(state, keys)
    peaks = biased_peak(amps, keys)
    if before is not None:
        held = before.join(amps, [*keys, "osc"]).select(*keys, F.col("osc").alias("__osc"), F.col("amp").alias("__amp"))
        peaks = peaks.join(held, keys, "left").select(*keys, F.when(F.col("__amp") >= keep * F.col("top"), F.col("__osc")).otherwise(F.col("peak")).alias("peak"), "top")
    phase = state.groupBy(*keys, F.col("osc").alias("peak")).agg(F.max_by("phase", "frame").alias("phase"))
    f = rhythm_frequency(F.col("peak"))
    rows = peaks.where("top > 0").join(phase, [*keys, "peak"]).select(*keys, F.col("peak").alias("osc"), f.alias("f"), (f * 60).alias("bpm"), "phase")
    return rows, companions(spark, state, keys, least_plv, least_amp, peaks.where("top > 0"))


def peak_hysteresis(state: DataFrame, keep: float = 0.8) -> DataFrame:
    """track, frame, peak: a frame keeps the last peak while it has `keep` of the largest amplitude.

    Each choice depends on the one before, so a track's frames fold in order in one task.
    """
    ship(state.sparkSession)
    prior = rhythm_prior(np.arange(N_OSC))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="frame", columns="osc", values="amp").sort_index()
        amps = grid.to_numpy()
        fresh, top = (amps * prior[grid.columns]).argmax(axis=1), amps.max(axis=1)
        peaks, last = [], -1
        for k in range(len(amps)):
            if last < 0 or amps[k, last] < keep * top[k]:
                last = fresh[k]
            peaks.append(last)
        return pd.DataFrame({"track": pdf["track"].iloc[0], "frame": grid.index, "peak": grid.columns.to_numpy()[peaks]})

    return state.select("track", "frame", "osc", "amp").groupBy("track").applyInPandas(fold, "track long, frame long, peak int")
