"""Aggregations over windows of a long state log, and the tonal extractors built on them.

`keys` names the columns of a window, such as ["track"] or ["track", "win"]. Each
operator shuffles once, by the window; the later steps reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.functions.common import clip, correlation, first_of_largest
from resonant.functions.music import pitch_class, ratio_consonance
from resonant.plans.dims import chord_templates, key_templates, pitch_frequency, rhythm_frequency


def mean_amp(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, osc, amp: the mean amplitude of each oscillator."""
    return state.groupBy(*keys, "osc").agg(F.avg("amp").alias("amp"))


def chroma(amps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pc, energy: amplitudes folded to twelve pitch classes, 0 where a class has none."""
    folded = amps.groupBy(*keys, pitch_class(pitch_frequency(F.col("osc"))).alias("pc")).agg(F.sum("amp").alias("energy"))
    spine = folded.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    return spine.join(folded, [*keys, "pc"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def _best_template(chromas: DataFrame, templates: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """The template with the largest correlation, ties to the first; a flat chroma has none."""
    scores = chromas.join(F.broadcast(templates), "pc").groupBy(*keys, "seq", *labels).agg(correlation(F.col("energy"), F.col("weight")).alias("score"))
    best = F.max_by(F.struct(*labels), F.struct(F.col("score"), -F.col("seq")))
    out = scores.groupBy(*keys).agg(best.alias("best"), F.max("score").alias("top"), F.median("score").alias("middle"))
    confidence = clip((F.col("top") - F.col("middle")) / 0.5, 0.0, 1.0)
    return out.select(*keys, *[F.col("best")[c].alias(c) for c in labels], F.when(F.col("top").isNotNull(), confidence).alias("confidence"))


def detect_key(spark: SparkSession, chromas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tonic, mode, confidence."""
    return _best_template(chromas, key_templates(spark), ["tonic", "mode"], keys)


def detect_chord(spark: SparkSession, chromas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, root, quality, name, confidence."""
    return _best_template(chromas, chord_templates(spark), ["root", "quality", "name"], keys)


def weights_chroma(weights: DataFrame) -> DataFrame:
    """track, pc, energy from the diagonal of a weight table: the other source of a key."""
    diagonal = weights.where("i = j").select("track", F.col("i").alias("osc"), F.hypot("re", "im").alias("amp"))
    return chroma(diagonal, ["track"])


def tempo(amps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bpm, confidence: the peak of the rhythm bank, refined by a parabola on the log-frequency axis."""
    order = Window.partitionBy(*keys).orderBy("osc")
    near = amps.withColumns({"before": F.lag("amp").over(order), "after": F.lead("amp").over(order)})
    top = F.max_by(F.struct("osc", "amp", "before", "after"), F.struct(F.col("amp"), -F.col("osc")))
    out = near.groupBy(*keys).agg(top.alias("p"), F.avg("amp").alias("mean"))
    a, b, c = F.col("p.before"), F.col("p.amp"), F.col("p.after")
    shift = clip(F.coalesce(F.try_divide(0.5 * (a - c), a - 2 * b + c), F.lit(0.0)), -0.5, 0.5)
    log_f = lambda d: F.ln(rhythm_frequency(F.col("p.osc") + d))
    refined = F.exp(log_f(0) + shift * (log_f(1) - log_f(-1)) / 2)
    f = F.when(a.isNull() | c.isNull(), rhythm_frequency(F.col("p.osc"))).otherwise(refined)
    return out.select(*keys, F.when(b > 0, f * 60).otherwise(0.0).alias("bpm"), F.when(b > 0, clip((b - F.col("mean")) / b, 0.0, 1.0)).otherwise(0.0).alias("confidence"))


def consonance(amps: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """keys, consonance: of the pairs of oscillators above a share of the peak, weighted by their amplitudes.

    Oscillators are filtered before they are paired.
    """
    peak = F.max("amp").over(Window.partitionBy(*keys))
    active = amps.withColumn("__peak", peak).where(F.col("amp") > share * F.col("__peak")).drop("__peak")
    other = active.select(*keys, F.col("osc").alias("other"), F.col("amp").alias("other_amp"))
    pairs = active.join(other, keys).where("osc < other")
    weight = F.col("amp") * F.col("other_amp")
    score = ratio_consonance(pitch_frequency(F.col("other")) / pitch_frequency(F.col("osc")))
    found = pairs.groupBy(*keys).agg(F.sum(weight * score).alias("__s"), F.sum(weight).alias("__w"))
    windows = amps.select(*keys).distinct()
    return windows.join(found, keys, "left").select(*keys, F.coalesce(F.try_divide("__s", "__w"), F.lit(0.0)).alias("consonance"))


def circular_mean(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase: amplitude-weighted; 0 without amplitude."""
    s, c = F.sum(F.col("amp") * F.sin("phase")), F.sum(F.col("amp") * F.cos("phase"))
    return state.groupBy(*keys).agg(F.when(F.sum("amp") > 0, F.atan2(s, c)).otherwise(0.0).alias("phase"))


def summary(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the golden figures of a layer, percentiles interpolated."""
    return state.groupBy(*keys).agg(
        F.countDistinct("frame").alias("n_snapshots"),
        F.countDistinct("osc").alias("n_oscillators"),
        F.avg("amp").alias("amp_mean"),
        F.max("amp").alias("amp_max"),
        F.expr("percentile(amp, 0.5D)").alias("amp_p50"),
        F.expr("percentile(amp, 0.95D)").alias("amp_p95"),
        F.avg(F.col("phantom").cast("double")).alias("phantom_fraction"),
    )


def strongest(state: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, place, osc, peak: the k oscillators with the largest peaks, ties to the higher."""
    peaks = state.groupBy(*keys, "osc").agg(F.max("amp").alias("peak"))
    order = Window.partitionBy(*keys).orderBy(F.desc("peak"), F.desc("osc"))
    return peaks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def peak_oscillator(amps: DataFrame, keys: list[str]) -> DataFrame:
    return amps.groupBy(*keys).agg(first_of_largest(F.col("amp"), F.col("osc")).alias("osc"), F.max("amp").alias("amp"))
