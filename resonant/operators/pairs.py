"""Pairs of oscillators: phase locking, envelope correlation, harmonic relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.functions.common import correlation, to_every_task, vector_length
from resonant.functions.music import is_harmonic
from resonant.plans.dims import LOCK_RATIOS, pitch_frequency, ratios
from resonant.session import ship


def active_oscillators(state: DataFrame, keys: list[str], floor: float, share: float = 0.0) -> DataFrame:
    """keys, osc: those whose mean amplitude is above the floor and a share of the window's largest."""
    means = state.groupBy(*keys, "osc").agg(F.avg("amp").alias("__mean"))
    peak = F.max("__mean").over(Window.partitionBy(*keys))
    return means.withColumn("__peak", peak).where((F.col("__mean") > floor) & (F.col("__mean") > share * F.col("__peak"))).select(*keys, "osc")


def frame_pairs(state: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each pair i < j of oscillators in each frame, with the columns of both.

    A frame is gathered once, as one row of as many entries as the bank has
    oscillators, and unfolds into its pairs where it lies: no join, and what sums the
    pairs up starts before anything moves again.
    """
    gathered = F.array_sort(F.collect_list(F.struct("osc", *columns)))
    rows = state.groupBy(*keys, "frame").agg(gathered.alias("__row"))
    first = rows.select(*keys, "frame", "__row", F.posexplode("__row").alias("__at", "__a"))
    both = first.select(*keys, "frame", "__a", F.explode(F.slice("__row", F.col("__at") + 2, F.size("__row"))).alias("__b"))
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{name}") for side, name in (("__a", "i"), ("__b", "j")) for c in columns]
    return both.select(*keys, "frame", F.col("__a.osc").alias("i"), F.col("__b.osc").alias("j"), *sides)


def mode_locks(spark: SparkSession, state: DataFrame, keys: list[str], threshold: float, pairs: list[tuple] = LOCK_RATIOS, active: DataFrame | None = None) -> DataFrame:
    """keys, i, j, p, q, plv of the pairs locked at a ratio.

    With `active`, other oscillators leave before pairs are made.
    """
    if active is not None:
        state = state.join(active, [*keys, "osc"], "left_semi")
    both = frame_pairs(state, keys, ["phase"]).crossJoin(F.broadcast(ratios(spark, pairs)))
    turn = F.col("q") * F.col("phase_i") - F.col("p") * F.col("phase_j")
    plv = vector_length(F.avg(F.cos(turn)), F.avg(F.sin(turn)))
    return both.groupBy(*keys, "i", "j", "p", "q").agg(plv.alias("plv")).where(F.col("plv") >= threshold)


def mode_locks_gram(state: DataFrame, threshold: float, pairs: list[tuple] = LOCK_RATIOS) -> DataFrame:
    """mode_locks of each track by one matrix product a ratio: for banks of hundreds of oscillators.

    The task's memory follows a track's frames times its oscillators, not their pairs in each frame.
    """
    ship(state.sparkSession)

    def locks(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="frame", columns="osc", values="phase")
        osc, phase = grid.columns.to_numpy(), grid.to_numpy()
        out = []
        for p, q in pairs:
            plv = np.abs(np.exp(1j * q * phase).T @ np.exp(-1j * p * phase)) / len(phase)
            i, j = np.nonzero(np.triu(plv >= threshold, 1))
            out.append(pd.DataFrame({"track": pdf["track"].iloc[0], "i": osc[i], "j": osc[j], "p": p, "q": q, "plv": plv[i, j]}))
        return pd.concat(out)

    return state.select("track", "frame", "osc", "phase").groupBy("track").applyInPandas(locks, "track long, i int, j int, p int, q int, plv double")


def envelope_correlation(state: DataFrame, keys: list[str], boost: float = 0.15, tolerance: float = 0.5) -> DataFrame:
    """keys, i, j, corr: of the amplitude envelopes, raised for harmonic pairs, at most 1.

    Two flat envelopes correlate fully, a flat and a moving one not at all.
    """
    both = frame_pairs(state, keys, ["amp"])
    flat = (F.stddev_pop("amp_i") == 0) & (F.stddev_pop("amp_j") == 0)
    found = both.groupBy(*keys, "i", "j").agg(correlation(F.col("amp_i"), F.col("amp_j")).alias("c"), flat.alias("flat"))
    c = F.coalesce("c", F.when(F.col("flat"), 1.0).otherwise(0.0))
    near = is_harmonic(pitch_frequency(F.col("i")), pitch_frequency(F.col("j")), tolerance)
    return found.select(*keys, "i", "j", F.when(near, F.least(F.lit(1.0), c + boost)).otherwise(c).alias("corr"))


def harmonic_pairs(bank: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """i, j of a bank's oscillators near a small-integer ratio."""
    a, b = bank.select(F.col("osc").alias("i"), F.col("f").alias("f_i")), bank.select(F.col("osc").alias("j"), F.col("f").alias("f_j"))
    return a.join(to_every_task(b), F.col("i") < F.col("j")).where(is_harmonic(F.col("f_i"), F.col("f_j"), tolerance)).select("i", "j")
