"""Small dimension tables: ratios, templates, profiles, names, and oscillator banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the tonal and rhythmic model.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
KEY_PROFILES = {
    "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
}
CHORD_TONES = {
    "maj": [0, 4, 7],
    "min": [0, 3, 7],
    "dom7": [0, 4, 7, 10],
    "maj7": [0, 4, 7, 11],
    "min7": [0, 3, 7, 10],
    "dim": [0, 3, 6],
    "sus4": [0, 5, 7],
    "sus2": [0, 2, 7],
}
CHORD_SUFFIXES = {"maj": "", "min": "m", "dom7": "7", "maj7": "maj7", "min7": "m7", "dim": "°", "sus4": "sus4", "sus2": "sus2"}
CONSONANCES = [(1, 1, 1.00), (2, 1, 0.92), (3, 2, 0.82), (4, 3, 0.72), (5, 4, 0.62), (5, 3, 0.55), (7, 4, 0.48), (8, 5, 0.40)]
CONSONANCE_SIGMA = 0.8  # semitones
COMPANION_RATIOS = [(2, 1), (3, 1), (3, 2), (4, 3), (5, 4), (7, 4), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]
HARMONIC_RATIOS = [(2, 1), (3, 1), (3, 2), (4, 1), (4, 3), (5, 1), (5, 4)]  # those of at least one
LOCK_RATIOS = [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 4)]
HARMONIC_LABELS = [(0.25, "0.250f"), (0.333, "0.333f"), (0.5, "0.500f"), (0.667, "0.667f"), (1.0, "1f (fund)"), (1.5, "1.5f"), (2.0, "2.0f"), (3.0, "3.0f"), (4.0, "4.0f"), (5.0, "5.0f"), (6.0, "6.0f"), (7.0, "7.0f"), (8.0, "8.0f")]
EAR_Q, LEAST_BANDWIDTH = 9.26449, 24.7

N_OSC = 32
PITCH_LOW, RHYTHM_LOW, RHYTHM_SPAN = 110.0, 0.5, 20.0


def table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Constant rows as a VALUES relation, which Catalyst folds and broadcasts by its known size."""

    def literal(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def ratios(spark: SparkSession, pairs: list[tuple]) -> DataFrame:
    return table(spark, "seq, p, q", [(k, p, q) for k, (p, q, *_) in enumerate(pairs)])


def key_templates(spark: SparkSession) -> DataFrame:
    """seq, tonic, mode, pc, weight: both profiles in all rotations, in order of preference."""
    rows = []
    for m, (mode, profile) in enumerate(KEY_PROFILES.items()):
        for tonic in range(12):
            rows += [(12 * m + tonic, PITCH_CLASSES[tonic], mode, (tonic + k) % 12, w) for k, w in enumerate(profile)]
    return table(spark, "seq, tonic, mode, pc, weight", rows)


def chord_templates(spark: SparkSession) -> DataFrame:
    """seq, root, quality, name, pc, weight: 0/1 masks in all rotations, in order of preference."""
    rows = []
    for m, (quality, tones) in enumerate(CHORD_TONES.items()):
        for root in range(12):
            name = PITCH_CLASSES[root] + CHORD_SUFFIXES[quality]
            rows += [(12 * m + root, PITCH_CLASSES[root], quality, name, pc, float((pc - root) % 12 in tones)) for pc in range(12)]
    return table(spark, "seq, root, quality, name, pc, weight", rows)


def geometric_bank(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """osc, f: n frequencies from low to high with a constant ratio."""
    step = F.col("id") / max(1, n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("osc"), (low * F.pow(F.lit(high / low), step)).alias("f"))


def tempered_bank(spark: SparkSession, low: float, high: float, per_semitone: int = 1, a4: float = 440.0) -> DataFrame:
    """k, f: the equal-tempered grid that covers low..high."""
    if not 0 < low < high or per_semitone < 1:
        raise ValueError("a grid needs 0 < low < high and at least one bin a semitone")
    bound = lambda hz: 12 * F.log2(F.lit(hz / a4)) * per_semitone
    ks = spark.range(1).select(F.explode(F.sequence(F.floor(bound(low)), F.ceil(bound(high)))).alias("k"))
    return ks.select("k", (a4 * F.pow(F.lit(2.0), F.col("k") / (12.0 * per_semitone))).alias("f"))


def erb_bank(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """channel, fc: centre frequencies evenly spaced on the ERB scale."""
    scale = EAR_Q * LEAST_BANDWIDTH
    at = lambda hz: EAR_Q * F.log(F.lit(1 + hz / scale))
    erb = at(low) + (at(high) - at(low)) * F.col("id") / max(1, n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("channel"), (scale * (F.exp(erb / EAR_Q) - 1)).alias("fc"))


def pitch_frequency(osc):
    return PITCH_LOW * F.pow(F.lit(2.0), osc / 12.0)


def rhythm_frequency(osc):
    return RHYTHM_LOW * F.pow(F.lit(RHYTHM_SPAN), osc / (N_OSC - 1.0))


def banks(spark: SparkSession) -> DataFrame:
    """osc, pitch_f, rhythm_f of the bank that the views use."""
    osc = F.col("id").cast("int")
    return spark.range(N_OSC).select(osc.alias("osc"), pitch_frequency(osc).alias("pitch_f"), rhythm_frequency(osc).alias("rhythm_f"))
