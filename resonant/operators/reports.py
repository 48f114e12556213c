"""Reports on features and voices: agreement of two runs, listings, replays, ages, slots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonant.functions.common import to_every_task
from resonant.functions.music import cents, harmonic_label
from resonant.operators.pairs import harmonic_pairs
from resonant.session import ship

VOICE = ("track", "voice")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], column: str, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """by, n, mean, most, middle, equal: how far a column differs between two runs over the keys that both have."""
    d = F.abs(F.col("__a") - F.col("__b"))
    both = a.select(*keys, F.col(column).alias("__a")).join(b.select(*keys, F.col(column).alias("__b")), keys).withColumn("__d", d)
    equal = F.avg((F.col("__d") <= tolerance).cast("double"))
    return both.groupBy(*by).agg(F.count("__d").alias("n"), F.avg("__d").alias("mean"), F.max("__d").alias("most"), F.median("__d").alias("middle"), equal.alias("equal"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], column: str, by: list[str], k: int = 5) -> DataFrame:
    """keys, place, diff: the k keys of each group at which the runs differ most, ties in the keys' order."""
    both = a.select(*keys, F.col(column).alias("__a")).join(b.select(*keys, F.col(column).alias("__b")), keys)
    both = both.select(*keys, F.abs(F.col("__a") - F.col("__b")).alias("diff"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("diff"), *keys))
    return both.withColumn("place", place).where(F.col("place") <= k)


def aligned(layers: DataFrame) -> DataFrame:
    """The frames of layers(track, layer, frame, ...) that every layer of the track reaches."""
    ends = layers.groupBy("track", "layer").agg(F.max("frame").alias("end")).groupBy("track").agg(F.min("end").alias("__end"))
    return layers.join(ends, "track").where(F.col("frame") <= F.col("__end")).drop("__end")


def band_counts(bank: DataFrame, low: float, high: float, keys: list[str]) -> DataFrame:
    """keys, low, mid, high: oscillators of bank(keys, f) under, within and over a band."""
    f = F.col("f")
    return bank.groupBy(*keys).agg(F.count_if(f < low).alias("low"), F.count_if((f >= low) & (f < high)).alias("mid"), F.count_if(f >= high).alias("high"))


def scaled_weights(weights: DataFrame, share: float = 0.98) -> DataFrame:
    """track, i, j, magnitude, level: magnitudes over the track's quantile, at most 1; weights(track, i, j, re, im).

    A track has as many weights as its bank has pairs.
    """
    sized = weights.select("track", "i", "j", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))
    top = sized.groupBy("track").agg(F.percentile("magnitude", F.lit(share)).alias("__top"))
    level = F.least(F.lit(1.0), F.coalesce(F.try_divide("magnitude", "__top"), F.lit(0.0)))
    return sized.join(top, "track").select("track", "i", "j", "magnitude", level.alias("level"))


def replay(voices: DataFrame, times: list[int], fundamental: float) -> DataFrame:
    """track, wanted, frame, place, voice, freq, cents, label: the voices of the first frame at or after each time, by frequency.

    One pass finds the frames: each time is an aggregate of its own.
    """
    first = [F.struct(F.lit(t).cast("long").alias("wanted"), F.min(F.when(F.col("frame") >= t, F.col("frame"))).alias("frame")) for t in times]
    frames = voices.groupBy("track").agg(F.array(*first).alias("__f")).select("track", F.explode("__f").alias("__f")).select("track", "__f.*")
    met = voices.join(frames.where("frame IS NOT NULL"), ["track", "frame"])
    place = F.row_number().over(Window.partitionBy("track", "wanted").orderBy("freq", "voice"))
    base = F.lit(fundamental)
    return met.select("track", "wanted", "frame", place.alias("place"), "voice", "freq", cents(F.col("freq"), base).alias("cents"), harmonic_label(F.col("freq"), base).alias("label"))


def ages(voices: DataFrame) -> DataFrame:
    """Adds first, age and gap: the voice's first frame, its earlier rows, and the frames it was silent before this one."""
    own = Window.partitionBy(*VOICE).orderBy("frame")
    before = F.lag("frame").over(own)
    return voices.withColumns({"first": F.first("frame").over(own), "age": F.row_number().over(own) - 1, "gap": F.coalesce(F.col("frame") - before - 1, F.lit(0).cast("long"))})


def carried(voices: DataFrame, most_silent: int) -> DataFrame:
    """track, frame, voice, silent: active voices, and silent ones until they return, retire or the track ends.

    A gap is bounded by most_silent, so every row unfolds to that many at most.
    """
    after = F.lead("frame").over(Window.partitionBy(*VOICE).orderBy("frame"))
    ends = voices.groupBy("track").agg(F.max("frame").alias("__end"))
    spans = voices.select("track", "voice", "frame", after.alias("__next")).join(ends, "track")
    last = F.least(F.coalesce(F.col("__next") - 1, F.col("__end")), F.col("frame") + most_silent)
    silent = F.explode(F.sequence(F.lit(0).cast("long"), last - F.col("frame")))
    return spans.select("track", "voice", "frame", silent.alias("silent")).select("track", (F.col("frame") + F.col("silent")).alias("frame"), "voice", "silent")


def history(voices: DataFrame, value: str, depth: int) -> DataFrame:
    """Adds history: the voice's last depth values, oldest first."""
    own = Window.partitionBy(*VOICE).orderBy("frame").rowsBetween(1 - depth, 0)
    return voices.withColumn("history", F.collect_list(value).over(own))


def voice_slots(voices: DataFrame, most: int, stale: int) -> DataFrame:
    """track, frame, voice, slot, begun: a voice takes the lowest free of the slots 0..most-1 at its first update that finds one.

    A voice without an update for more than `stale` frames gives its slot back; when it
    comes again, it begins anew. slot is null while all are taken, begun is the frame at
    which the voice began. Which slot is free depends on all that came before, so a
    track's updates fold in order; they stream through, and only living voices are held.
    """
    ship(voices.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, now = None, None
        seen: dict[int, tuple[int, int]] = {}  # last update and beginning of each living voice
        held: dict[int, int] = {}
        for batch in batches:
            slot, begun = [], []
            for t, f, v in zip(*(c.to_pylist() for c in batch.columns)):
                if t != track:
                    track, now, seen, held = t, None, {}, {}
                if f != now:
                    now = f
                    for old in [x for x, (last, _) in seen.items() if last < f - stale]:
                        del seen[old]
                        held.pop(old, None)
                seen[v] = (f, seen[v][1] if v in seen else f)
                if v not in held and len(held) < most:
                    held[v] = min(set(range(most)).difference(held.values()))
                slot.append(held.get(v))
                begun.append(seen[v][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot, pa.int32()), pa.array(begun, pa.int64())], names=["track", "frame", "voice", "slot", "begun"])

    rows = voices.select("track", "frame", "voice").repartition("track").sortWithinPartitions("track", "frame", "voice")
    return rows.mapInArrow(fold, "track long, frame long, voice long, slot int, begun long")


def slotted_traces(voices: DataFrame, most: int, depth: int, stale: int) -> DataFrame:
    """track, voice, slot, frame, freq, amp, history: the latest state of every living voice that has a slot.

    The history goes back to the voice's beginning, `depth` values at most.
    """
    end = voices.groupBy("track").agg(F.max("frame").alias("__end"))
    own = Window.partitionBy(*VOICE, "begun").orderBy("frame").rowsBetween(1 - depth, 0)
    known = voices.join(voice_slots(voices, most, stale), ["track", "frame", "voice"]).withColumn("history", F.collect_list("amp").over(own))
    latest = known.groupBy(*VOICE).agg(F.max_by(F.struct("slot", "frame", "freq", "amp", "history"), "frame").alias("__l"))
    living = latest.join(end, "track").where((F.col("__l.frame") >= F.col("__end") - stale) & F.col("__l.slot").isNotNull())
    return living.select(*VOICE, "__l.*")


def ring(state: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Adds place: the rows of the last `depth` frames of each key, the oldest at 0; fewer while the ring fills."""
    own = Window.partitionBy(*keys).orderBy(F.desc("frame"))
    kept = state.withColumn("__back", F.row_number().over(own)).where(F.col("__back") <= depth)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1).drop("__back")


def missing(required: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of required that found lacks, each once: empty if found contains them all."""
    return required.select(*required.columns).distinct().join(found.select(*required.columns).distinct(), required.columns, "left_anti")


def baseline_json(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: the figures of a summary as one JSON object, in the order of its columns."""
    return summaries.select(*keys, F.to_json(F.struct(*[c for c in summaries.columns if c not in keys])).alias("json"))


def trigger_report(coverage: DataFrame, phantoms: DataFrame, voices: DataFrame) -> DataFrame:
    """triggers, covered, coverage, voice_frames, phantom_frames, phantom: totals and their shares of what there is."""
    t = coverage.agg(F.count("*").alias("triggers"), F.count_if("covered").alias("covered"))
    p, v = phantoms.agg(F.count("*").alias("phantom_frames")), voices.agg(F.count("*").alias("voice_frames"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return t.crossJoin(v).crossJoin(p).select("triggers", "covered", share("covered", "triggers").alias("coverage"), "voice_frames", "phantom_frames", share("phantom_frames", "voice_frames").alias("phantom"))


def guide_pairs(weights: DataFrame, bank: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """track, i, j, magnitude of the pairs i < j of bank(osc, f) near a small-integer ratio."""
    found = weights.where("i < j").select("track", "i", "j", F.hypot("re", "im").alias("magnitude"))
    return found.join(to_every_task(harmonic_pairs(bank, tolerance)), ["i", "j"]).select("track", "i", "j", "magnitude")


def dominant(voices: DataFrame) -> DataFrame:
    """track, frame, voice, amp: the loudest voice of each frame, of equals the smallest."""
    best = F.max_by(F.struct("voice", "amp"), F.struct("amp", -F.col("voice")))
    return voices.groupBy("track", "frame").agg(best.alias("__b")).select("track", "frame", "__b.*")


def listing(voices: DataFrame, most: int = 8) -> DataFrame:
    """track, voice, frames, low, high, middle: frequencies of the first voices of a track by number."""
    ids = voices.select(*VOICE).distinct()
    few = ids.withColumn("__place", F.row_number().over(Window.partitionBy("track").orderBy("voice"))).where(F.col("__place") <= most)
    f = F.col("freq")
    kept = voices.join(few.select(*VOICE), list(VOICE))
    return kept.groupBy(*VOICE).agg(F.count("*").alias("frames"), F.min(f).alias("low"), F.max(f).alias("high"), F.median(f).alias("middle"))


def padded(df: DataFrame, at: Column, half: int, keys: list[str], value: str) -> DataFrame:
    """keys, frame, value in the window around a frame, 0 where the data has none."""
    spine = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(at - half, at + half)).alias("frame"))
    return spine.join(df.select(*keys, "frame", value), [*keys, "frame"], "left").select(*keys, "frame", F.coalesce(value, F.lit(0.0)).alias(value))
