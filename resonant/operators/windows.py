"""Window functions and frame lookups. A window is partitioned by track and oscillator, never global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonant.functions.common import vector_length
from resonant.operators import rollups
from resonant.operators.rhythm import biased_peak


def rolling_coherence(state: DataFrame, frames: int = 12) -> DataFrame:
    """Adds coherence: the length of the mean phase vector over the last frames."""
    if frames <= 1:
        return state.withColumn("coherence", F.lit(1.0))
    over = Window.partitionBy("track", "osc").orderBy("frame").rowsBetween(1 - frames, 0)
    return state.withColumn("coherence", vector_length(F.avg(F.cos("phase")).over(over), F.avg(F.sin("phase")).over(over)))


def median_smooth(df: DataFrame, value: str, keys: list[str], order: str, k: int = 5) -> DataFrame:
    """Adds smooth: the median of k values around each, fewer at the ends."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k // 2), k // 2)
    return df.withColumn("smooth", F.expr(f"percentile({value}, 0.5D)").over(over))


def centred_windows(frames: DataFrame, half: int, stride: int) -> DataFrame:
    """track, win, lo, hi: a window around every stride-th frame, cut at the ends; frames(track, frame)."""
    last = frames.groupBy("track").agg(F.max("frame").alias("last"))
    centres = last.select("track", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(stride).cast("long"))).alias("win"))
    return centres.select("track", "win", F.greatest(F.col("win") - half, F.lit(0)).alias("lo"), F.least(F.col("win") + half, F.col("last")).alias("hi"))


def in_windows(state: DataFrame, windows: DataFrame) -> DataFrame:
    """state once for each window that holds its frame.

    A window names its frames, so the join has an equality on track and frame.
    """
    spread = windows.select("track", "win", F.explode(F.sequence("lo", "hi")).alias("frame"))
    return state.join(spread, ["track", "frame"])


def timeline(amps: DataFrame, keys: list[str], order: str = "win", share: float = 0.1) -> DataFrame:
    """keys and the tonal and rhythmic features of each window of amps(keys, osc, amp); tempo and consonance also smoothed along a track."""
    spark = amps.sparkSession
    chroma = rollups.chroma(amps, keys)
    key = rollups.detect_key(spark, chroma, keys).withColumnRenamed("confidence", "key_confidence")
    chord = rollups.detect_chord(spark, chroma, keys).select(*keys, F.col("name").alias("chord"), F.col("confidence").alias("chord_confidence"))
    tempo = rollups.tempo(amps, keys).withColumnRenamed("confidence", "tempo_confidence")
    peak = biased_peak(amps, keys).select(*keys, "peak")
    out = key.join(chord, keys).join(tempo, keys).join(rollups.consonance(amps, keys, share), keys).join(peak, keys)
    along = [k for k in keys if k != order]
    for value in ("bpm", "consonance"):
        out = median_smooth(out, value, along, order).withColumnRenamed("smooth", f"smooth_{value}")
    return out


def trailing(state: DataFrame, frames: int, least: int) -> DataFrame:
    """track, osc, frame, mean, n over the last frames, where there are at least `least`."""
    over = Window.partitionBy("track", "osc").orderBy("frame").rowsBetween(1 - frames, 0)
    found = state.withColumns({"mean": F.avg("amp").over(over), "n": F.count("*").over(over)})
    return found.where(F.col("n") >= least).select("track", "osc", "frame", "mean", "n")


def forward_fill(spine: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """spine(track, frame) with the last value at or before each frame."""
    over = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    joined = spine.join(values, ["track", "frame"], "left")
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(over))


def as_of_forward(times: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Each time with the first snapshot at or after it, else the last one; (keys, t) and (keys, t, value).

    One sort of both sides together, no pairs.
    """
    both = times.select(*keys, "t", F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asks"))
    both = both.unionByName(snapshots.select(*keys, "t", F.col("t").alias("at"), F.col("value").cast("double").alias("value"), F.lit(0).alias("asks")))
    down = Window.partitionBy(*keys).orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    pick = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.max_by(F.col(c), F.col("at")).over(everything))
    found = both.select(*keys, "t", "asks", pick("at").alias("at"), pick("value").alias("value"))
    return found.where("asks = 1").drop("asks")


def around(at: Column, half: int, last: Column) -> Column:
    """The frames within `half` of a playhead, cut at both ends."""
    return F.sequence(F.greatest(at - half, F.lit(0).cast("long")), F.least(at + half, last))


def nearest_frame(t: Column, hz: float, last: Column) -> Column:
    """The frame nearest to t seconds, halves to even, within 0..last."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.bround(t * hz).cast("long"), last))


def phase_wrapped(state: DataFrame) -> DataFrame:
    """Adds wrapped: the phase fell by more than a quarter turn since the frame before."""
    before = F.lag("phase").over(Window.partitionBy("track", "osc").orderBy("frame"))
    return state.withColumn("wrapped", F.coalesce(F.col("phase") < before - F.lit(1.5707963267948966), F.lit(False)))


def trace_segments(voices: DataFrame, floor: float = 0.02) -> DataFrame:
    """Consecutive frames of a voice with a frequency: start and end of a line, and its width."""
    over = Window.partitionBy("track", "voice").orderBy("frame")
    ahead = {c: F.lead(c).over(over) for c in ("frame", "freq", "amp")}
    lines = voices.select("track", "voice", "frame", "freq", "amp", *[v.alias(f"next_{c}") for c, v in ahead.items()])
    lines = lines.where("next_frame = frame + 1 AND freq > 0 AND next_freq > 0")
    above = lambda c: F.greatest(F.lit(0.0), F.col(c) - floor)
    width = (above("amp") + above("next_amp")) / 2
    lines = lines.withColumn("__w", width)
    peak = lines.groupBy("track").agg(F.max("__w").alias("__peak"))
    return lines.join(peak, "track").withColumn("width", F.coalesce(F.try_divide("__w", "__peak"), F.lit(0.0))).drop("__w", "__peak")
