"""Address matching, value scaling and output specifications of the router."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from resonant.plans.dims import PITCH_CLASSES


def address_matches(pattern: Column, address: Column) -> Column:
    """Equal numbers of segments, each equal or * in the pattern."""
    parts = lambda c: F.split(F.regexp_replace(c, "^/+|/+$", ""), "/")
    pairs = F.zip_with(parts(pattern), parts(address), lambda p, a: (p == "*") | (p == a))
    return (F.size(parts(pattern)) == F.size(parts(address))) & F.forall(pairs, lambda same: F.coalesce(same, F.lit(False)))


def number(arg: Column) -> Column:
    return arg.try_cast("double")


def volts_of_tonic(arg: Column, octave: int = 4) -> Column:
    """One volt an octave; null for an unknown name."""
    place = F.array_position(F.array(*[F.lit(n) for n in PITCH_CLASSES]), arg)
    return F.when(place > 0, octave + (place - 1) / 12.0)


def sawtooth(arg: Column, low: float = 0.0, high: float = 5.0) -> Column:
    turn = (number(arg) + math.pi) / (2 * math.pi)
    return low + (high - low) * (turn - F.floor(turn))


def unit_volts(arg: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), 5 * number(arg)))


#: Scale functions by the names that rules use; add entries to extend the router.
SCALES: dict[str, Callable[[Column], Column]] = {
    "tonic_to_1v_per_oct": volts_of_tonic,
    "phase_to_sawtooth": sawtooth,
    "unit_to_5v": unit_volts,
    "passthrough": number,
}


def scaled(scale: Column, arg: Column) -> Column:
    """The rule's scale applied; an unknown name passes numbers through."""
    out = number(arg)
    for name, function in SCALES.items():
        if name != "passthrough":
            out = F.when(scale == name, function(arg)).otherwise(out)
    return out


def output_kind(spec: Column) -> Column:
    return F.substring_index(spec, "/", 1)


def output_channel(spec: Column) -> Column:
    """The number of cv/<n> or midi/cc/<n>, null if there is none."""
    rest = F.substring(spec, F.length(output_kind(spec)) + 2, F.length(spec))
    control = F.when(rest.startswith("cc/"), F.substring(rest, F.lit(4), F.length(rest)))
    return F.when(output_kind(spec) == "midi", control).otherwise(rest).try_cast("int")


def control_value(value: Column) -> Column:
    """0..127, fractions dropped."""
    return F.greatest(F.lit(0), F.least(F.lit(127), value.cast("int")))
