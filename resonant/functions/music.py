"""Pitch, interval and consonance expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from resonant.functions.common import let
from resonant.plans.dims import CONSONANCE_SIGMA, CONSONANCES, HARMONIC_LABELS, HARMONIC_RATIOS, PITCH_CLASSES


def _names() -> Column:
    return F.array(*[F.lit(n) for n in PITCH_CLASSES])


def pitch_class(hz: Column) -> Column:
    """0..11 with C = 0, halves to even; a frequency that is not positive is an error."""
    number = F.pmod(F.bround(12 * F.log2(hz / 440.0) + 9).cast("int"), F.lit(12))
    return F.when(hz > 0, number).otherwise(F.raise_error(F.lit("a frequency must be positive")).cast("int"))


def pitch_class_name(pc: Column) -> Column:
    return F.get(_names(), pc)


def note_name(hz: Column, a4: float = 440.0) -> Column:
    """Nearest note with its octave and the signed cents to it."""
    semis = 12 * F.log2(hz / a4)
    nearest = F.bround(semis).cast("int")
    cents = F.bround((semis - nearest) * 100).cast("int")
    midi = nearest + 69
    name = F.concat(F.get(_names(), F.pmod(midi, F.lit(12))), (F.floor(midi / 12) - 1).cast("string"), F.when(cents >= 0, "+").otherwise(""), cents.cast("string"))
    return F.when(hz > 0, name).otherwise(F.lit("—"))


def log_frequency(hz: Column) -> Column:
    return F.ln(F.greatest(hz, F.lit(1e-9)))


def semitones_between(a: Column, b: Column) -> Column:
    return F.abs(12 * F.log2(a / b))


def ratio_consonance(ratio: Column) -> Column:
    """The largest of the simple ratios' stabilities, falling with the distance from each."""
    at = 12 * F.log2(ratio)
    scores = [s * F.exp(-F.pow(at - 12 * F.log2(F.lit(p / q)), F.lit(2)) / (2 * CONSONANCE_SIGMA**2)) for p, q, s in CONSONANCES]
    return F.greatest(*scores)


def is_harmonic(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    """Whether two frequencies are near a small-integer ratio."""
    at = 12 * F.log2(F.greatest(a, b) / F.least(a, b))
    near = F.lit(False)
    for p, q in HARMONIC_RATIOS:
        near = near | (F.abs(at - 12 * F.log2(F.lit(p / q))) <= tolerance)
    return (a > 0) & (b > 0) & near


def cents(hz: Column, reference: Column) -> Column:
    return F.when((hz > 0) & (reference > 0), 1200 * F.log2(hz / reference)).otherwise(F.lit(float("inf")))


def tempo_prior(hz: Column, centre: float = 2.0, sigma: float = 1.0) -> Column:
    return F.exp(-0.5 * F.pow((F.log2(F.greatest(hz, F.lit(1e-9))) - F.log2(F.lit(centre))) / sigma, F.lit(2)))


def harmonic_label(hz: Column, fundamental: Column) -> Column:
    """The multiple of the fundamental that hz is within a semitone of, else a question mark."""
    off = lambda ratio: F.abs(1200 * F.log2(hz / (fundamental * ratio)))
    nearest = F.array_min(F.array(*[F.struct(off(r).alias("off"), F.lit(label).alias("label")) for r, label in HARMONIC_LABELS]))
    return F.when((hz > 0) & (fundamental > 0), let(nearest, lambda x: F.when(x["off"] < 100, x["label"]).otherwise("?"))).otherwise("?")


def beat_pulse(phase: Column) -> Column:
    """Within an eighth of a turn of the beat."""
    return F.abs(phase) < math.pi / 4
