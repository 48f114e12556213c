"""Voices: clusters of oscillators whose envelopes move together, kept apart over time.

Clustering a window is DataFrame work up to the graph; the graph has as many nodes as
the bank has oscillators, so its components are found in the window's own task.
Tracking carries identities from window to window and folds a track in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonant.functions.common import clip, to_every_task, vector_length
from resonant.functions.music import log_frequency, semitones_between
from resonant.operators.pairs import active_oscillators, envelope_correlation
from resonant.operators.windows import in_windows
from resonant.plans.config import VoiceConfig
from resonant.plans.dims import HARMONIC_RATIOS, N_OSC, pitch_frequency
from resonant.session import ship


def active_correlations(state: DataFrame, keys: list[str], config: VoiceConfig = VoiceConfig()) -> DataFrame:
    """keys, i, j, corr of the active oscillators' envelopes."""
    active = active_oscillators(state, keys, config.noise_floor, config.active_fraction)
    kept = state.join(active, [*keys, "osc"], "left_semi")
    return envelope_correlation(kept, keys, config.harmonic_boost, config.harmonic_tolerance)


def smallest_member(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def clusters(state: DataFrame, keys: list[str], config: VoiceConfig = VoiceConfig(), pairs: DataFrame | None = None) -> DataFrame:
    """keys, cluster, osc: cluster is its smallest oscillator; lone oscillators are clusters too.

    pairs are active_correlations(), if the caller has them.
    """
    ship(state.sparkSession)
    active = active_oscillators(state, keys, config.noise_floor, config.active_fraction)
    if pairs is None:
        pairs = active_correlations(state, keys, config)
    strong = pairs.where(F.col("corr") > config.correlation)
    edges = active.select(*keys, F.col("osc").alias("i"), F.col("osc").alias("j")).unionByName(strong.select(*keys, "i", "j"))

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        label = smallest_member(int(pdf[["i", "j"]].to_numpy().max()) + 1, pdf["i"].to_numpy(), pdf["j"].to_numpy())
        osc = np.unique(pdf["i"].to_numpy())
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "cluster": label[osc].astype(np.int32), "osc": osc.astype(np.int32)})

    fields = ", ".join(f"{k} long" for k in keys)
    found = edges.groupBy(*keys).applyInPandas(components, f"{fields}, cluster int, osc int")
    size = F.count("*").over(Window.partitionBy(*keys, "cluster"))
    return found.withColumn("__size", size).where(F.col("__size") >= config.least_size).drop("__size")


def cluster_stats(state: DataFrame, members: DataFrame, keys: list[str], config: VoiceConfig = VoiceConfig(), pairs: DataFrame | None = None) -> DataFrame:
    """keys, cluster, size, centre, amp, phase, confidence.

    The centre is the amplitude-weighted geometric mean frequency, the phase the
    circular mean in the window's last frame, the confidence the mean correlation of
    the cluster's pairs, 1 for a lone oscillator. pairs are the correlations that the
    clusters were made from, if the caller has them.
    """
    own = state.join(members, [*keys, "osc"])
    each = own.groupBy(*keys, "cluster", "osc").agg(F.avg("amp").alias("a"), F.max_by("phase", "frame").alias("p"))
    a, f = F.col("a"), pitch_frequency(F.col("osc"))
    stats = each.groupBy(*keys, "cluster").agg(
        F.count("*").alias("size"),
        F.when(F.sum(a) > 0, F.exp(F.try_divide(F.sum(a * F.ln(f)), F.sum(a)))).otherwise(F.min(f)).alias("centre"),
        F.avg(a).alias("amp"),
        F.when(F.sum(a) > 0, F.atan2(F.sum(a * F.sin("p")), F.sum(a * F.cos("p")))).otherwise(0.0).alias("phase"),
    )
    if pairs is None:
        pairs = envelope_correlation(own.select(*state.columns), keys, config.harmonic_boost, config.harmonic_tolerance)
    left = members.select(*keys, "cluster", F.col("osc").alias("i"))
    right = members.select(*keys, "cluster", F.col("osc").alias("j"))
    inside = pairs.join(left, [*keys, "i"]).join(right, [*keys, "cluster", "j"]).groupBy(*keys, "cluster").agg(F.avg("corr").alias("c"))
    return stats.join(inside, [*keys, "cluster"], "left").select(*keys, "cluster", "size", "centre", "amp", "phase", clip(F.coalesce("c", F.lit(1.0)), 0.0, 1.0).alias("confidence"))


def match_cost(centre: Column, amp: Column, members: Column, old_centre: Column, old_amp: Column, old_members: Column, config: VoiceConfig = VoiceConfig()) -> Column:
    """Semitones apart, difference in amplitude, and one minus the overlap of the oscillator sets, weighted."""
    union = F.size(F.array_union(members, old_members))
    overlap = F.when(union > 0, F.size(F.array_intersect(members, old_members)) / union).otherwise(0.0)
    semis = F.abs(log_frequency(centre) - log_frequency(old_centre)) * 12 / F.ln(F.lit(2.0))
    return config.weight_pitch * semis + config.weight_amp * F.abs(amp - old_amp) + config.weight_overlap * (1 - overlap)


def envelopes(state: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cluster, frame, env: the mean amplitude of a voice's oscillators."""
    return state.join(members, [*keys, "osc"]).groupBy(*keys, "cluster", "frame").agg(F.avg("amp").alias("env"))


def associate(env: DataFrame, bank: DataFrame, keys: list[str], hz: float, low_bpm: float = 60.0, high_bpm: float = 240.0) -> DataFrame:
    """keys, cluster, osc, bpm, confidence: the bank's oscillator at which each voice's envelope has the most power.

    bank(osc, f) is cut to the band before the join. Envelopes of fewer than eight
    frames and flat ones have no match.
    """
    band = bank.where(F.col("f").between(low_bpm / 60, high_bpm / 60))
    own = Window.partitionBy(*keys, "cluster")
    centred = env.withColumns({"mean": F.avg("env").over(own), "sd": F.stddev_pop("env").over(own), "n": F.count("*").over(own), "first": F.min("frame").over(own)})
    centred = centred.where("n >= 8 AND sd >= 1e-6 AND mean > 0")
    turn = 2 * np.pi * F.col("f") * (F.col("frame") - F.col("first")) / hz
    x = F.col("env") - F.col("mean")
    power = vector_length(F.avg(x * F.cos(turn)), F.avg(x * F.sin(turn)))
    spectrum = centred.crossJoin(to_every_task(band)).groupBy(*keys, "cluster", "osc", "f").agg(power.alias("power"))
    best = F.max_by(F.struct("osc", "f"), F.struct("power", -F.col("osc")))
    out = spectrum.groupBy(*keys, "cluster").agg(best.alias("b"), F.max("power").alias("top"), F.avg("power").alias("mean")).where("top > 0")
    return out.select(*keys, "cluster", F.col("b.osc").alias("osc"), (F.col("b.f") * 60).alias("bpm"), clip((F.col("top") - F.col("mean")) / F.col("top"), 0.0, 1.0).alias("confidence"))


# --- tracking --------------------------------------------------------------------------------


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest complete matching of the smaller side; -1 for none.

    Shortest augmenting paths with potentials.
    """
    rows, columns = cost.shape
    if rows > columns:
        of_column = assignment(cost.T)
        out = np.full(rows, -1)
        for c, r in enumerate(of_column):
            out[r] = c
        return out
    price_r, price_c = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for row in range(rows):
        dist, back = cost[row] - price_r[row] - price_c, np.full(columns, -1)
        done, path = np.zeros(columns, bool), 0.0
        while True:
            c = int(np.argmin(np.where(done, np.inf, dist)))
            path, done[c] = dist[c], True
            if owner[c] < 0:
                break
            r = owner[c]
            through = path + cost[r] - price_r[r] - price_c
            better = ~done & (through < dist)
            dist[better], back[better] = through[better], c
        settled = np.flatnonzero(done)
        for s in settled:
            if owner[s] >= 0:
                price_r[owner[s]] += path - dist[s]
            price_c[s] -= path - dist[s]
        price_r[row] += path
        while True:
            previous = back[c]
            owner[c] = row if previous < 0 else owner[previous]
            if previous < 0:
                break
            c = previous
    out = np.full(rows, -1)
    for c in np.flatnonzero(owner >= 0):
        out[owner[c]] = c
    return out


@dataclass(frozen=True)
class Voice:
    id: int
    members: frozenset[int]
    centre: float
    amp: float
    phase: float
    confidence: float
    active: bool = True
    age: int = 0
    silent: int = 0


@dataclass
class Tracker:
    """Voices so far and the next identity; `advance` takes a window's clusters."""

    config: VoiceConfig = field(default_factory=VoiceConfig)
    voices: list[Voice] = field(default_factory=list)
    next_id: int = 0

    def _cost(self, new: Voice, old: Voice) -> float:
        c = self.config
        union = len(new.members | old.members)
        overlap = len(new.members & old.members) / union if union else 0.0
        semis = 12 * abs(np.log2(max(new.centre, 1e-9) / max(old.centre, 1e-9)))
        return c.weight_pitch * semis + c.weight_amp * abs(new.amp - old.amp) + c.weight_overlap * (1 - overlap)

    def advance(self, found: list[Voice]) -> list[Voice]:
        found = sorted(found, key=lambda v: (-v.amp, min(v.members, default=0)))
        matched: dict[int, int] = {}
        if found and self.voices:
            cost = np.array([[self._cost(n, o) for o in self.voices] for n in found])
            gated = np.where(cost <= self.config.cost_cap, cost, 1e6)
            matched = {i: j for i, j in enumerate(assignment(gated)) if j >= 0 and gated[i, j] < 1e6}
        now = []
        for i, v in enumerate(found):
            if i in matched:
                old = self.voices[matched[i]]
                now.append(replace(v, id=old.id, age=old.age + 1))
            else:
                now.append(replace(v, id=self.next_id))
                self.next_id += 1
        taken = set(matched.values())
        for j, old in enumerate(self.voices):
            if j not in taken and old.silent + 1 <= self.config.most_silent:
                now.append(replace(old, active=False, age=old.age + 1, silent=old.silent + 1))
        self.voices = now
        return now


def window_voices(amps: np.ndarray, last_phase: np.ndarray, f: np.ndarray, config: VoiceConfig) -> list[Voice]:
    """The clusters of one window of amplitudes (frames, oscillators), without identities."""
    if len(amps) < 2:
        return []
    mean = amps.mean(axis=0)
    on = np.flatnonzero(mean > max(config.noise_floor, config.active_fraction * mean.max()))
    if not len(on):
        return []
    x = amps[:, on] - amps[:, on].mean(axis=0)
    sd = x.std(axis=0)
    flat = sd == 0
    corr = (x / np.where(flat, 1, sd)).T @ (x / np.where(flat, 1, sd)) / len(x)
    corr[np.ix_(flat, flat)] = 1.0
    semis = 12 * np.abs(np.log2(f[on][:, None] / f[on][None, :]))
    near = np.any([np.abs(semis - 12 * np.log2(p / q)) <= config.harmonic_tolerance for p, q in HARMONIC_RATIOS], axis=0)
    corr = np.where(near, np.minimum(1.0, corr + config.harmonic_boost), corr)
    i, j = np.nonzero(np.triu(corr > config.correlation, 1))
    label = smallest_member(len(on), i, j)
    out = []
    for c in np.unique(label):
        k = np.flatnonzero(label == c)
        if len(k) < config.least_size:
            continue
        osc, a = on[k], mean[on[k]]
        pairs = corr[np.ix_(k, k)][np.triu_indices(len(k), 1)]
        phase = np.arctan2((a * np.sin(last_phase[osc])).sum(), (a * np.cos(last_phase[osc])).sum())
        centre = np.exp((a * np.log(f[osc])).sum() / a.sum())
        out.append(Voice(-1, frozenset(osc.tolist()), float(centre), float(a.mean()), float(phase), float(np.clip(pairs.mean() if len(pairs) else 1.0, 0, 1))))
    return out


VOICES = "track long, frame long, voice long, active boolean, centre double, amp double, phase double, confidence double, age long, silent long, members array<int>"


def voice_rows(track: int, frame: int, voices: list[Voice]) -> list[tuple]:
    return [(track, frame, v.id, v.active, v.centre, v.amp, v.phase, v.confidence, v.age, v.silent, sorted(v.members)) for v in voices]


FOUND = "track long, at long, members array<array<int>>, numbers array<array<double>>"


def found_voices(state: DataFrame, half: int, stride: int, config: VoiceConfig = VoiceConfig(), stretch: int = 64) -> DataFrame:
    """track, at, members, numbers (centre, amp, phase, confidence): the clusters around every stride-th frame, without identities.

    A track is cut into stretches of so many frames; a frame goes to each stretch that
    has a window with it, so that windows of one track are clustered in many tasks.
    """
    ship(state.sparkSession)
    f = 110.0 * 2 ** (np.arange(N_OSC) / 12)
    gathered = F.array_sort(F.collect_list(F.struct("osc", "amp", "phase")))
    rows = state.groupBy("track", "frame").agg(gathered.alias("r"))
    of = lambda c: F.transform("r", lambda x: x[c])
    frame = F.col("frame")
    spread = F.sequence(F.floor(F.greatest(frame - half, F.lit(0)) / stretch), F.floor((frame + half) / stretch))
    spread = rows.select("track", "frame", of("amp").alias("amp"), of("phase").alias("phase"), F.explode(spread).alias("part"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frames, amp = pdf["frame"].to_numpy(), np.array(pdf["amp"].tolist())
        out = []
        first, last = int(key[1]) * stretch, min((int(key[1]) + 1) * stretch - 1, int(frames[-1]))
        for at in range(-(-first // stride) * stride, last + 1, stride):
            lo, hi = np.searchsorted(frames, [at - half, at + half + 1])
            found = window_voices(amp[lo:hi], np.asarray(pdf["phase"].iloc[hi - 1], float), f, config) if hi > lo else []
            out.append((int(key[0]), at, [sorted(v.members) for v in found], [[v.centre, v.amp, v.phase, v.confidence] for v in found]))
        return pd.DataFrame(out, columns=["track", "at", "members", "numbers"])

    return spread.groupBy("track", "part").applyInPandas(run, FOUND)


def track_voices(state: DataFrame, half: int, stride: int, config: VoiceConfig = VoiceConfig()) -> DataFrame:
    """The voices of each track around every stride-th frame, with identities that persist.

    Only the tracker sees a track as a whole, and only its clusters.
    """
    columns = [c.strip().split()[0] for c in VOICES.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, rows = Tracker(config), []
        for at, members, numbers in pdf.sort_values("at")[["at", "members", "numbers"]].itertuples(index=False):
            found = [Voice(-1, frozenset(int(o) for o in m), *(float(x) for x in n)) for m, n in zip(members, numbers)]
            rows += voice_rows(int(pdf["track"].iloc[0]), int(at), tracker.advance(found))
        return pd.DataFrame(rows, columns=columns)

    return found_voices(state, half, stride, config).groupBy("track").applyInPandas(run, VOICES)


# --- reports ---------------------------------------------------------------------------------


def lifecycle(voices: DataFrame) -> DataFrame:
    """track, voice and its first and last frame, frames active, frequency range and drift in octaves."""
    on = voices.where("active")
    return on.groupBy("track", "voice").agg(
        F.min("frame").alias("first"),
        F.max("frame").alias("last"),
        F.count("*").alias("frames"),
        F.min("centre").alias("low"),
        F.max("centre").alias("high"),
        F.median("centre").alias("middle"),
        F.abs(F.log2(F.max_by("centre", "frame") / F.min_by("centre", "frame"))).alias("drift"),
    )


def simultaneous(voices: DataFrame) -> DataFrame:
    """track and the mean and largest number of active voices in a frame, and the distinct voices."""
    frames = voices.groupBy("track", "frame").agg(F.count_if("active").alias("n"))
    ids = voices.where("active").groupBy("track").agg(F.countDistinct("voice").alias("voices"))
    return frames.groupBy("track").agg(F.avg("n").alias("mean"), F.max("n").alias("most")).join(ids, "track", "left")


def top_changes(voices: DataFrame, by: str = "freq") -> DataFrame:
    """track, changes: how often the first active voice is another than in the frame before.

    by is freq, id or first: the voice of the lowest frequency, number or first frame.
    """
    first = voices.withColumn("first_seen", F.min("frame").over(Window.partitionBy("track", "voice")))
    order = {"freq": F.struct("centre", "voice"), "id": F.struct("voice"), "first": F.struct("first_seen", "voice")}[by]
    low = first.where("active").groupBy("track", "frame").agg(F.min_by("voice", order).alias("top"))
    frames = voices.select("track", "frame").distinct().join(low, ["track", "frame"], "left")
    before = F.lag("top").over(Window.partitionBy("track").orderBy("frame"))
    changed = F.count_if(F.col("top").isNotNull() & F.col("before").isNotNull() & (F.col("top") != F.col("before")))
    return frames.withColumn("before", before).groupBy("track").agg(changed.alias("changes"))


def coverage(voices: DataFrame, triggers: DataFrame, cents: float = 200.0) -> DataFrame:
    """trigger, covered, voice: the loudest active voice near a trigger's frequency while it sounds.

    voices(track, frame, voice, freq, amp), triggers(trigger, track, first, last, freq). A trigger names the
    frames that it sounds in; a frequency that many triggers have is looked up once for each frame. That
    join is on track, frame and a band of frequency as wide as the tolerance: a voice is in its own band and
    the next ones.
    """
    spread = triggers.select("trigger", "track", F.col("freq").alias("wanted"), F.explode(F.sequence("first", "last")).alias("frame"))
    asks = spread.select("track", "frame", "wanted").distinct().withColumn("band", _band("wanted", cents))
    band = _band("freq", cents)
    near = voices.withColumn("band", F.explode(F.sequence(band - 1, band + 1)))
    met = asks.join(near, ["track", "frame", "band"]).where(semitones_between(F.col("freq"), F.col("wanted")) * 100 < cents)
    loudest = met.groupBy("track", "frame", "wanted").agg(F.max(F.struct("amp", (-F.col("voice")).alias("voice"))).alias("loudest"))
    found = spread.join(loudest, ["track", "frame", "wanted"])
    best = found.groupBy("trigger").agg(F.max(F.struct("loudest.amp", "loudest.voice", -F.col("frame"))).alias("best")).select("trigger", (-F.col("best.voice")).alias("voice"))
    return triggers.select("trigger").join(best, "trigger", "left").select("trigger", F.col("voice").isNotNull().alias("covered"), "voice")


def _band(freq: str, cents: float) -> Column:
    """The number of the band of a frequency, bands as wide as the tolerance."""
    return F.floor(F.log2(F.col(freq)) * 1200 / cents)


def phantom_voices(voices: DataFrame, triggers: DataFrame, cents: float = 200.0) -> DataFrame:
    """The voice frames that no trigger explains."""
    band = _band("freq", cents)
    spread = triggers.select("track", F.col("freq").alias("wanted"), band.alias("band"), F.explode(F.sequence("first", "last")).alias("frame")).distinct()
    spread = spread.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    voices = voices.withColumn("__band", band)
    near = semitones_between(voices["freq"], spread["wanted"]) * 100 < cents
    same = (voices["track"] == spread["track"]) & (voices["frame"] == spread["frame"]) & (voices["__band"] == spread["band"])
    return voices.join(spread, same & near, "left_anti").drop("__band")


def with_phase(matches: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """matches(keys, cluster, osc, bpm, confidence) with freq, and the phase of the bank's oscillator in the window's last frame."""
    last = state.groupBy(*keys, "osc").agg(F.max_by("phase", "frame").alias("phase"))
    return matches.join(last, [*keys, "osc"]).withColumn("freq", F.col("bpm") / 60)


def window_bank(voices: DataFrame, env: DataFrame, bank: DataFrame, state: DataFrame, keys: list[str], hz: float, name: str) -> DataFrame:
    """voices(keys, cluster, ...) with a struct `name` of the bank's best match: osc, freq, bpm, phase, confidence; null without one."""
    found = with_phase(associate(env, bank, keys, hz), state, keys)
    match = F.struct("osc", "freq", "bpm", "phase", "confidence").alias(name)
    return voices.join(found.select(*keys, "cluster", match), [*keys, "cluster"], "left")


def tracked_banks(voices: DataFrame, state: DataFrame, layers: dict[str, DataFrame], bank: DataFrame, half: int, hz: float) -> DataFrame:
    """track_voices() with a struct for each of layers(track, frame, osc, phase): the best match of each active voice in that bank.

    A voice's envelope is the mean amplitude of its oscillators over the window of its
    frame; the phase is that of the matched oscillator in the window's last frame. A
    silent voice keeps what it had.
    """
    keys = ["track", "win"]
    spoken = voices.where("active").select("track", F.col("frame").alias("win"), F.col("voice").alias("cluster"), F.explode("members").alias("osc"))
    wins = spoken.select(*keys).distinct().select(*keys, F.greatest(F.col("win") - half, F.lit(0)).alias("lo"), (F.col("win") + half).alias("hi"))
    env = envelopes(in_windows(state.select("track", "frame", "osc", "amp"), wins), spoken, keys)
    found = associate(env, bank, keys, hz)
    for name, layer in layers.items():
        last = in_windows(layer.select("track", "frame", "osc", "phase"), wins)
        matches = with_phase(found, last, keys).withColumnsRenamed({"win": "frame", "cluster": "voice"})
        voices = with_bank_match(voices, matches, name, ["osc", "freq", "bpm", "phase", "confidence"])
    return voices


def with_bank_match(voices: DataFrame, matches: DataFrame, name: str, fields: list[str] | None = None) -> DataFrame:
    """Adds a struct of the matched oscillator; an active voice without a match has null, a silent one keeps what it had."""
    m = matches.select("track", "frame", "voice", F.struct(*(fields or ["osc", "bpm", "confidence"])).alias("__match"))
    joined = voices.join(m, ["track", "frame", "voice"], "left")
    over = Window.partitionBy("track", "voice").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.when(F.col("active"), F.struct(F.col("__match").alias("m")))
    last = F.last(spoken, ignorenulls=True).over(over)["m"]
    return joined.withColumn(name, F.when(F.col("active"), F.col("__match")).otherwise(last)).drop("__match")


