"""Generated signals, as expressions over spark.range: they scale with the cluster, not the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def adsr(t: Column, duration: Column, attack: float = 0.01, decay: float = 0.05, sustain: float = 0.7, release: float = 0.1) -> Column:
    """Envelope of a note at t seconds after its start, held for duration."""
    held = F.when(t < attack, t / attack).when(t < attack + decay, 1 - (1 - sustain) * (t - attack) / decay).otherwise(sustain)
    return F.when((t < 0) | (t >= duration + release), 0.0).when(t < duration, held).otherwise(sustain * (1 - (t - duration) / release))


def notes(spark: SparkSession, triggers: DataFrame, seconds: float, rate: int) -> DataFrame:
    """n, t, x: sines under envelopes, summed; triggers(start, duration, freq, velocity)."""
    grid = spark.range(int(seconds * rate)).select(F.col("id").alias("n"), (F.col("id") / rate).alias("t"))
    # a note meets only the whole seconds that it sounds in
    spread = triggers.withColumn("__second", F.explode(F.sequence(F.floor("start"), F.floor(F.col("start") + F.col("duration") + 0.1))))
    met = grid.withColumn("__second", F.floor("t")).join(spread, "__second")
    local = F.col("t") - F.col("start")
    x = F.col("velocity") * adsr(local, F.col("duration")) * F.sin(2 * math.pi * F.col("freq") * local)
    sums = met.where((local >= 0) & (local < F.col("duration") + 0.1)).groupBy("n").agg(F.sum(x).alias("x"))
    return grid.join(sums, "n", "left").select("n", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def pulse_train(spark: SparkSession, bpm: float, seconds: float, rate: int, burst: float = 0.02) -> DataFrame:
    """n, t, x: decaying bursts on each beat."""
    t = F.col("id") / rate
    since = F.pmod(t, F.lit(60.0 / bpm))
    x = F.when(since < burst, 0.8 * F.exp(-8 * since / burst)).otherwise(0.0)
    return spark.range(int(seconds * rate)).select(F.col("id").alias("n"), t.alias("t"), x.alias("x"))


def peak_normalized(signal: DataFrame, peak: float = 0.8) -> DataFrame:
    """x scaled to the peak; an all-zero signal stays."""
    largest = signal.agg(F.max(F.abs("x")).alias("__peak"))
    return signal.crossJoin(F.broadcast(largest)).withColumn("x", F.when(F.col("__peak") > 0, F.col("x") / F.col("__peak") * peak).otherwise(F.col("x"))).drop("__peak")
