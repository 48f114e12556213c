"""More queries of the catalogue: timelines, replay, rhythm and MIDI messages, weights, reports. Same conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.catalog import (
    AMPS, BIASED, CENTRED, CHORD_ROWS, CLUSTERING, CLUSTERS, KEY_ROWS, MESSAGES, NEAR, RULE_SQL, SIGNAL, STATE, TRACK, TRIGGERS, VOICE_FRAMES, WEIGHTS,
    BANK, consonance_sql, corr_sql, harmonic_sql, plv_sql, query, r, rounded, values,
)
from resonant.catalog import _active_voices, _last_frame, _rules, _tracks, _weights
from resonant.operators import dynamics, messages, reports, rhythm, rollups, signals, voices, windows
from resonant.plans import dims
from resonant.plans.config import BankConfig
from resonant.session import work_folder
from resonant.sources import files, views
from resonant.streaming import engine, live
from resonant.streaming.engine import EngineConfig


def extractors_sql(keys: str, share: float) -> str:
    """CTEs key_, chord_, tempo_ and cons_ over amps(keys, osc, pf, rf, amp)."""
    both = " AND ".join(f"p.{k} = t.{k}" for k in keys.split(", "))
    of = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"""pcs AS (SELECT {keys}, CAST(((round_even(12 * log2(pf / 440) + 9, 0) % 12) + 12) % 12 AS INTEGER) AS pc, amp FROM amps),
chroma AS (SELECT {of}, CAST(k AS INTEGER) AS pc, coalesce(sum(p.amp), 0e0) AS energy FROM (SELECT DISTINCT {keys} FROM amps) t CROSS JOIN range(12) x(k) LEFT JOIN pcs p ON {both} AND p.pc = k GROUP BY {of}, k),
{values("kt", "seq, tonic, mode, pc, weight", KEY_ROWS)}, {values("ct", "seq, root, quality, name, pc, weight", CHORD_ROWS)},
ks AS (SELECT {keys}, seq, tonic, mode, {corr_sql("energy", "weight")} AS score FROM chroma JOIN kt USING (pc) GROUP BY ALL),
cs AS (SELECT {keys}, seq, name, {corr_sql("energy", "weight")} AS score FROM chroma JOIN ct USING (pc) GROUP BY ALL),
key_ AS (SELECT * FROM (SELECT {keys}, tonic, mode, greatest(0e0, least(1e0, (score - median(score) OVER (PARTITION BY {keys})) / 0.5e0)) AS key_confidence, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, seq) AS place FROM ks) WHERE place = 1),
chord_ AS (SELECT * FROM (SELECT {keys}, name AS chord, greatest(0e0, least(1e0, (score - median(score) OVER (PARTITION BY {keys})) / 0.5e0)) AS chord_confidence, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, seq) AS place FROM cs) WHERE place = 1),
near AS (SELECT *, lag(amp) OVER w AS a, lead(amp) OVER w AS c, row_number() OVER (PARTITION BY {keys} ORDER BY amp DESC, osc) AS place, avg(amp) OVER (PARTITION BY {keys}) AS mean FROM amps WINDOW w AS (PARTITION BY {keys} ORDER BY osc)),
pd AS (SELECT *, greatest(-0.5e0, least(0.5e0, coalesce(0.5e0 * (a - c) / nullif(a - 2 * amp + c, 0), 0e0))) AS d FROM near WHERE place = 1),
tempo_ AS (SELECT {keys}, 60 * CASE WHEN a IS NULL OR c IS NULL THEN rf ELSE exp(ln(rf) + d * (ln(0.5e0 * pow(20e0, (osc + 1) / 31e0)) - ln(0.5e0 * pow(20e0, (osc - 1) / 31e0))) / 2) END AS bpm, greatest(0e0, least(1e0, (amp - mean) / amp)) AS tempo_confidence FROM pd),
act AS (SELECT * FROM (SELECT *, max(amp) OVER (PARTITION BY {keys}) AS top FROM amps) WHERE amp > {share!r}e0 * top),
pr AS (SELECT {of}, t.amp * p.amp AS w, {consonance_sql("p.pf / t.pf")} AS s FROM act t JOIN act p ON {both} AND t.osc < p.osc),
cons_ AS (SELECT {of}, coalesce(sum(w * s) / nullif(sum(w), 0), 0e0) AS consonance FROM (SELECT DISTINCT {keys} FROM amps) t LEFT JOIN pr p ON {both} GROUP BY {of})"""


TICK_COLUMNS = f"tonic, mode, {r('key_confidence')} AS key_confidence, chord, {r('chord_confidence')} AS chord_confidence, {r('bpm')} AS bpm, {r('tempo_confidence')} AS tempo_confidence, {r('consonance')} AS consonance"


def _frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    """track, frame, amp as an array over the bank."""
    s = views.osc_state(spark, sf)
    return s.groupBy("track", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("osc", "amp"))), lambda x: x["amp"]).alias("amp"))


# --- timelines and replay --------------------------------------------------------------------


@query(f"""WITH RECURSIVE {STATE}, fr AS (SELECT track, frame, arg_max(osc, ROW({BIASED}, -osc)) AS fresh, max(amp) AS top FROM st GROUP BY ALL),
fold AS (SELECT track, frame, fresh AS peak FROM fr WHERE frame = 0 UNION ALL
  SELECT f.track, f.frame, CASE WHEN s.amp >= 0.8e0 * f.top THEN p.peak ELSE f.fresh END FROM fold p JOIN fr f ON f.track = p.track AND f.frame = p.frame + 1 JOIN st s ON s.track = f.track AND s.frame = f.frame AND s.osc = p.peak),
amps AS (SELECT track, frame, osc, pf, rf, amp FROM st), {extractors_sql("track, frame", 0.8)}
SELECT track, frame, {TICK_COLUMNS}, peak FROM key_ JOIN chord_ USING (track, frame) JOIN tempo_ USING (track, frame) JOIN cons_ USING (track, frame) JOIN fold USING (track, frame)""")
def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """All extractors at each tick of the state log, which arrives as a stream."""
    return rounded(live.replay(_frame_rows(spark, sf), work_folder(spark, "replay"), share=0.8))


@query(f"WITH {STATE} SELECT track, CAST(count(*) AS BIGINT) AS n, 0e0 AS mean, 0e0 AS most, 0e0 AS middle, 1e0 AS equal FROM (SELECT DISTINCT track, frame FROM st) GROUP BY track")
def replay_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Consonance in batch against the replayed stream: they agree."""
    frames = _frame_rows(spark, sf)
    streamed = live.replay(frames, work_folder(spark, "parity"), share=0.8)
    amps = frames.select("track", "frame", F.posexplode("amp").alias("osc", "amp"))
    batch = rollups.consonance(amps, ["track", "frame"], 0.8)
    return rounded(reports.agreement(batch, streamed, ["track", "frame"], "consonance", TRACK, 1e-9))


@query(f"""WITH {STATE}, {CENTRED}, amps AS (SELECT * FROM wa), {extractors_sql("track, win", 0.9)},
pk AS (SELECT track, win, arg_max(osc, ROW({BIASED}, -osc)) AS peak FROM wa GROUP BY ALL)
SELECT track, win, {TICK_COLUMNS}, peak, {r("median(bpm) OVER w")} AS smooth_bpm, {r("median(consonance) OVER w")} AS smooth_consonance
FROM key_ JOIN chord_ USING (track, win) JOIN tempo_ USING (track, win) JOIN cons_ USING (track, win) JOIN pk USING (track, win) WINDOW w AS (PARTITION BY track ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def feature_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Key, chord, tempo, consonance and rhythm peak of each window, tempo and consonance smoothed."""
    s, keys = views.osc_state(spark, sf), ["track", "win"]
    amps = rollups.mean_amp(windows.in_windows(s, windows.centred_windows(s, 12, 6)), keys)
    return rounded(windows.timeline(amps, keys, share=0.9))


@query(f"WITH {STATE}, l AS (SELECT track, max(frame) AS last FROM st GROUP BY track) SELECT s.track, s.osc, s.frame, CAST(s.frame - greatest(0, l.last - 15) AS INTEGER) AS place, {r('s.amp')} AS amp FROM st s JOIN l USING (track) WHERE s.frame > l.last - 16")
def ring_latest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.ring(views.osc_state(spark, sf), 16, ["track", "osc"]).select("track", "osc", "frame", "place", "amp"))


@query(f"WITH {STATE}, l AS (SELECT track, max(frame) AS last FROM st GROUP BY track), h AS (SELECT track, f AS frame, a AS at FROM l, (VALUES (0), (20), (1000000)) x(a), range(0, last + 1) y(f) WHERE f BETWEEN greatest(least(a, last) - 6, 0) AND least(least(a, last) + 6, last)) SELECT h.track, CAST(h.at AS BIGINT) AS at, s.frame, {r('sum(s.amp)')} AS energy FROM h JOIN st s USING (track, frame) GROUP BY ALL")
def playhead_slice(spark: SparkSession, sf: str) -> DataFrame:
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    last = e.groupBy("track").agg(F.max("frame").alias("last"))
    asks = last.select("track", "last", F.explode(F.array(*[F.lit(a).cast("long") for a in (0, 20, 1_000_000)])).alias("at"))
    frames = windows.around(F.least(F.col("at"), F.col("last")), 6, F.col("last"))
    return rounded(asks.select("track", "at", F.explode(frames).alias("frame")).join(e, ["track", "frame"]).select("track", "at", "frame", "energy"))


# --- rhythm, voices and their messages -------------------------------------------------------

NUMBER = "CASE WHEN address LIKE '%/ratio' OR address LIKE '%_ids' THEN NULL ELSE round(CAST(arg AS DOUBLE), 6) + 0e0 END"


def _numbered(sent: DataFrame) -> DataFrame:
    """Messages with numbers as numbers, so that the writing of a number does not matter."""
    text = F.col("address").endswith("/ratio") | F.col("address").endswith("_ids")
    return rounded(sent.withColumn("value", F.when(~text, F.col("arg").try_cast("double"))).withColumn("arg", F.when(text, F.col("arg"))))


@query(f"""WITH {AMPS}, {values("ratios", "seq, p, q", [(k, p, q) for k, (p, q) in enumerate(dims.COMPANION_RATIOS)])},
fresh AS (SELECT track, arg_max(osc, ROW({BIASED}, -osc)) AS peak, max(amp) AS top FROM amps GROUP BY track),
pk AS (SELECT f.track, CASE WHEN a.amp >= 0.95e0 * f.top THEN 12 ELSE f.peak END AS peak, f.top FROM fresh f JOIN amps a ON a.track = f.track AND a.osc = 12),
aim AS (SELECT *, 0.5e0 * pow(20e0, peak / 31e0) * p / q AS aim FROM pk, ratios),
near AS (SELECT track, seq, p, q, peak, top, arg_min(o, ROW(abs(0.5e0 * pow(20e0, o / 31e0) - aim), o)) AS osc FROM aim, range(32) t(o) WHERE aim BETWEEN 0.5e0 AND 10e0 GROUP BY ALL),
ok AS (SELECT n.* FROM near n JOIN amps a ON a.track = n.track AND a.osc = n.osc WHERE n.osc <> n.peak AND a.amp >= 0.3e0 * n.top),
m AS (SELECT k.track, k.seq, k.p, k.q, k.osc, count(*) AS n, {plv_sql("k.p * b.phase - k.q * a.phase")} AS plv, max_by(a.phase, a.frame) AS phase
  FROM ok k JOIN st a ON a.track = k.track AND a.osc = k.osc JOIN st b ON b.track = k.track AND b.osc = k.peak AND b.frame = a.frame GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq) - 1 AS place FROM m WHERE n >= 4 AND plv >= 0.1e0),
pp AS (SELECT p.track, p.peak, 0.5e0 * pow(20e0, p.peak / 31e0) AS f, max_by(s.phase, s.frame) AS phase FROM pk p JOIN st s ON s.track = p.track AND s.osc = p.peak GROUP BY ALL),
msg AS (SELECT track, '/rhythm/peak/freq' AS address, CAST(NULL AS VARCHAR) AS arg, f AS value FROM pp UNION ALL SELECT track, '/rhythm/peak/bpm', NULL, f * 60 FROM pp UNION ALL SELECT track, '/rhythm/peak/phase', NULL, phase FROM pp UNION ALL SELECT track, '/rhythm/peak/idx', NULL, peak FROM pp
UNION ALL SELECT p.track, '/rhythm/companion/count', NULL, (SELECT count(*) FROM c WHERE c.track = p.track) FROM pp p
UNION ALL SELECT track, '/rhythm/companion/' || place || '/ratio', p || '/' || q, NULL FROM c UNION ALL SELECT track, '/rhythm/companion/' || place || '/freq', NULL, 0.5e0 * pow(20e0, osc / 31e0) FROM c
UNION ALL SELECT track, '/rhythm/companion/' || place || '/phase', NULL, phase FROM c UNION ALL SELECT track, '/rhythm/companion/' || place || '/plv', NULL, plv FROM c)
SELECT track, address, arg, {r("CAST(value AS DOUBLE)")} AS value FROM msg""")
def rhythm_osc_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Peak and companions as messages; the peak was 12 before and stays while it has 95 % of the largest amplitude."""
    s = views.osc_state(spark, sf)
    before = s.select("track").distinct().withColumn("osc", F.lit(12))
    peaks, found = rhythm.structure(spark, s, TRACK, before, keep=0.95, least_plv=0.1)
    return _numbered(messages.rhythm_messages(peaks, found, TRACK))


def _match_sql(name: str, sign: str) -> str:
    return f"""{name} AS (SELECT k.track, k.cluster, k.osc, k.f AS freq, k.f * 60 AS bpm, l.phase * {sign} AS phase, (k.power - k.mean) / k.power AS confidence FROM rk k JOIN lastp l ON l.track = k.track AND l.osc = k.osc WHERE k.place = 1 AND k.power > 0)"""


MATCHES = f"""{CLUSTERS}, env AS (SELECT m.track, m.cluster, s.frame, avg(s.amp) AS env FROM members m JOIN st s USING (track, osc) GROUP BY ALL),
cen AS (SELECT * FROM (SELECT *, avg(env) OVER w AS mean, stddev_pop(env) OVER w AS sd, count(*) OVER w AS n, min(frame) OVER w AS first FROM env WINDOW w AS (PARTITION BY track, cluster)) WHERE n >= 8 AND sd >= 1e-6 AND mean > 0),
bank AS (SELECT CAST(o AS INTEGER) AS osc, 0.5e0 * pow(20e0, o / 31e0) AS f FROM range(32) t(o)),
sp AS (SELECT track, cluster, osc, f, sqrt(pow(avg((env - mean) * cos(2 * pi() * f * (frame - first) / 20e0)), 2) + pow(avg((env - mean) * sin(2 * pi() * f * (frame - first) / 20e0)), 2)) AS power
  FROM cen, bank WHERE f BETWEEN 1e0 AND 4e0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY track, cluster ORDER BY power DESC, osc) AS place, avg(power) OVER (PARTITION BY track, cluster) AS mean FROM sp),
lastp AS (SELECT track, osc, max_by(phase, frame) AS phase FROM st GROUP BY ALL), {_match_sql("rhythm", "1e0")}, {_match_sql("motor", "-1e0")}"""


def _voice_banks(spark: SparkSession, sf: str) -> DataFrame:
    """track, cluster, rhythm, motor: a window's voices with the best match in both banks.

    The motor bank has the rhythm bank's frequencies and the opposite phases.
    """
    s = views.osc_state(spark, sf)
    members = voices.clusters(s, TRACK, CLUSTERING)
    env = voices.envelopes(s, members, TRACK)
    bank = dims.banks(spark).select("osc", F.col("rhythm_f").alias("f"))
    found = voices.window_bank(members.select("track", "cluster").distinct(), env, bank, s, TRACK, 20.0, "rhythm")
    return voices.window_bank(found, env, bank, s.withColumn("phase", -F.col("phase")), TRACK, 20.0, "motor")


@query(f"""WITH RECURSIVE {MATCHES}, v AS (SELECT DISTINCT track, cluster FROM members)
SELECT v.track, v.cluster, a.osc AS rhythm_osc, {r("a.bpm")} AS rhythm_bpm, {r("a.phase")} AS rhythm_phase, {r("a.confidence")} AS rhythm_confidence, b.osc AS motor_osc, {r("b.bpm")} AS motor_bpm, {r("b.phase")} AS motor_phase, {r("b.confidence")} AS motor_confidence
FROM v LEFT JOIN rhythm a USING (track, cluster) LEFT JOIN motor b USING (track, cluster)""")
def voice_banks(spark: SparkSession, sf: str) -> DataFrame:
    named = [F.col(f"{bank}.{c}").alias(f"{bank}_{c}") for bank in ("rhythm", "motor") for c in ("osc", "bpm", "phase", "confidence")]
    return rounded(_voice_banks(spark, sf).select("track", "cluster", *named))


def _bank_messages(name: str) -> str:
    parts = {"freq": "freq", "bpm": "bpm", "phase": "phase", "osc_idx": "CAST(osc AS DOUBLE)", "confidence": "confidence"}
    return " UNION ALL ".join(f"SELECT track, '/voice/' || cluster || '/{name}/{k}' AS address, {v} AS value FROM {name}" for k, v in parts.items())


@query(f"WITH RECURSIVE {MATCHES} SELECT track, address, {r('value')} AS value FROM ({_bank_messages('rhythm')} UNION ALL {_bank_messages('motor')})")
def voice_bank_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The ten messages of each voice's rhythm and motor; those of the voice itself are in voice_osc_messages."""
    zero = F.lit(0.0)
    v = _voice_banks(spark, sf).withColumnRenamed("cluster", "voice").withColumns({"frame": F.lit(0).cast("long"), "active": F.lit(True), "centre": zero, "amp": zero, "phase": zero, "confidence": zero, "age": F.lit(0), "silent": F.lit(0)})
    sent = messages.voice_messages(v).where("address LIKE '/voice/%/rhythm/%' OR address LIKE '/voice/%/motor/%'")
    return rounded(sent.select("track", "address", F.col("arg").cast("double").alias("value")))


@query()
def tracked_voice_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked voices with their rhythm and motor, as messages."""
    s = views.osc_state(spark, sf)
    found = voices.track_voices(s, 25, 4, CLUSTERING)
    bank = dims.banks(spark).select("osc", F.col("rhythm_f").alias("f"))
    both = voices.tracked_banks(found, s, {"rhythm": s, "motor": s.withColumn("phase", -F.col("phase"))}, bank, 25, 20.0)
    return _numbered(messages.voice_messages(both))


@query(f"WITH {VOICE_FRAMES}, s AS (SELECT *, min(frame) OVER (PARTITION BY track, voice) AS seen FROM vf), n AS (SELECT track, frame, min(voice) AS a, arg_min(voice, ROW(seen, voice)) AS b FROM s GROUP BY ALL), c AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM n WINDOW w AS (PARTITION BY track ORDER BY frame)) SELECT track, CAST(count(*) FILTER (a <> pa) AS BIGINT) AS by_id, CAST(count(*) FILTER (b <> pb) AS BIGINT) AS by_first FROM c GROUP BY track")
def top_changes_by(spark: SparkSession, sf: str) -> DataFrame:
    v = _active_voices(spark, sf)
    return voices.top_changes(v, "id").withColumnRenamed("changes", "by_id").join(voices.top_changes(v, "first").withColumnRenamed("changes", "by_first"), "track")


@query(f"""WITH {VOICE_FRAMES}, {TRIGGERS}, m AS (SELECT DISTINCT t.trigger FROM trg t JOIN vf v ON v.track = t.track AND v.frame BETWEEN t.first AND t.last AND {NEAR}),
ph AS (SELECT count(*) AS n FROM vf v WHERE NOT EXISTS (SELECT 1 FROM trg t WHERE v.track = t.track AND v.frame BETWEEN t.first AND t.last AND {NEAR})),
c AS (SELECT (SELECT count(*) FROM trg) AS t, (SELECT count(*) FROM m) AS m, (SELECT count(*) FROM vf) AS v, (SELECT n FROM ph) AS p)
SELECT CAST(t AS BIGINT) AS triggers, CAST(m AS BIGINT) AS covered, {r("m / CAST(t AS DOUBLE)")} AS coverage, CAST(v AS BIGINT) AS voice_frames, CAST(p AS BIGINT) AS phantom_frames, {r("p / CAST(v AS DOUBLE)")} AS phantom FROM c""")
def trigger_report(spark: SparkSession, sf: str) -> DataFrame:
    v, t = views.voice_frames(spark, sf), views.triggers(spark, sf)
    return rounded(reports.trigger_report(voices.coverage(v, t, 250.0), voices.phantom_voices(v, t, 250.0), v))


@query(f"WITH {VOICE_FRAMES} SELECT DISTINCT track, voice FROM vf EXCEPT SELECT track, voice FROM vf WHERE frame = (SELECT max(frame) FROM vf)")
def missing_voices(spark: SparkSession, sf: str) -> DataFrame:
    """The voices that the last frame does not contain."""
    v = views.voice_frames(spark, sf)
    last = v.groupBy("track").agg(F.max("frame").alias("frame"))
    return reports.missing(v.select("track", "voice"), v.join(last, ["track", "frame"]).select("track", "voice"))


def _colour_sql(p: int, i: int, f: int) -> str:
    on, share = "CASE WHEN amp > 0.15e0 AND abs(re) < 0.05e0 THEN 0.85e0 ELSE 0e0 END", "least(1e0, greatest(abs(re) - 0.1e0 * amp, 0e0) / 0.3e0)"
    return f"{f / 255!r}e0 * {share} + ({i / 255!r}e0 * {on} + {p / 255!r}e0 * (1 - {on})) * (1 - {share})"


@query(f"WITH {STATE} SELECT track, frame, osc, {r(_colour_sql(0xF0, 0x80, 0xE0))} AS r, {r(_colour_sql(0xE8, 0x20, 0x40))} AS g, {r(_colour_sql(0xD0, 0x10, 0x30))} AS b FROM st")
def strip_colours(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    on = dynamics.phantom(F.col("amp"), F.abs("re"), 0.15, 0.05)
    cell = dynamics.blended(on, F.abs("re") - 0.1 * F.col("amp"), 0.3, "#F0E8D0", "#802010", "#E04030")
    return rounded(s.select("track", "frame", "osc", cell.alias("c")).select("track", "frame", "osc", "c.*"))


_EXTRACTORS = extractors_sql("track", 0.9).replace("act AS", "xact AS").replace("FROM act t JOIN act p", "FROM xact t JOIN xact p").replace("near AS", "xnear AS").replace("FROM near WHERE", "FROM xnear WHERE")


def _list_sql(value: str) -> str:
    return f"coalesce(string_agg({value}, '+' ORDER BY v.cluster), '-')"


@query(f"""WITH RECURSIVE {MATCHES}, amps AS (SELECT track, osc, pf, rf, avg(amp) AS amp FROM st GROUP BY ALL), {_EXTRACTORS},
{values("cratios", "seq, p, q", [(k, p, q) for k, (p, q) in enumerate(dims.COMPANION_RATIOS)])},
pk AS (SELECT track, arg_max(osc, ROW({BIASED}, -osc)) AS peak, max(amp) AS top FROM amps GROUP BY track),
aim AS (SELECT *, 0.5e0 * pow(20e0, peak / 31e0) * p / q AS aim FROM pk, cratios),
cnear AS (SELECT track, seq, p, q, peak, top, arg_min(o, ROW(abs(0.5e0 * pow(20e0, o / 31e0) - aim), o)) AS osc FROM aim, range(32) t(o) WHERE aim BETWEEN 0.5e0 AND 10e0 GROUP BY ALL),
ok AS (SELECT n.* FROM cnear n JOIN amps a ON a.track = n.track AND a.osc = n.osc WHERE n.osc <> n.peak AND a.amp >= 0.3e0 * n.top),
cm AS (SELECT k.track, k.seq, count(*) AS n, {plv_sql("k.p * b.phase - k.q * a.phase")} AS plv FROM ok k JOIN st a ON a.track = k.track AND a.osc = k.osc JOIN st b ON b.track = k.track AND b.osc = k.peak AND b.frame = a.frame GROUP BY ALL),
cc AS (SELECT track, count(*) AS n FROM cm WHERE n >= 4 AND plv >= 0.1e0 GROUP BY track),
v AS (SELECT m.track, m.cluster, a.bpm AS rb, b.bpm AS mb FROM (SELECT DISTINCT track, cluster FROM members) m LEFT JOIN rhythm a USING (track, cluster) LEFT JOIN motor b USING (track, cluster)),
vl AS (SELECT track, CAST(count(*) AS VARCHAR) AS n_voices, {_list_sql("CAST(cluster AS VARCHAR)")} AS voice_ids, {_list_sql("coalesce(printf('%.0f', rb), '?')")} AS rhythm_bpms, {_list_sql("coalesce(printf('%.0f', mb), '?')")} AS motor_bpms FROM v GROUP BY track)
SELECT k.track, '0.500' AS t, k.tonic, k.mode, c.chord, printf('%.3f', 60 * 0.5e0 * pow(20e0, peak / 31e0)) AS bpm, printf('%.4f', l.phase) AS peak_phase, printf('%.4f', 0.5e0 * pow(20e0, peak / 31e0)) AS peak_freq,
CAST(coalesce(cc.n, 0) AS VARCHAR) AS n_companions, printf('%.4f', s.consonance) AS consonance, n_voices, voice_ids, rhythm_bpms AS voice_rhythm_bpms, motor_bpms AS voice_motor_bpms
FROM key_ k JOIN chord_ c USING (track) JOIN cons_ s USING (track) JOIN pk USING (track) JOIN lastp l ON l.track = k.track AND l.osc = pk.peak JOIN vl ON vl.track = k.track LEFT JOIN cc ON cc.track = k.track""")
def feature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole line of the feature export, over each track as one window."""
    s = views.osc_state(spark, sf)
    amps = rollups.mean_amp(s, TRACK)
    chroma = rollups.chroma(amps, TRACK)
    peaks, found = rhythm.structure(spark, s, TRACK, least_plv=0.1)
    features = rollups.detect_key(spark, chroma, TRACK).select("track", "tonic", "mode").join(rollups.detect_chord(spark, chroma, TRACK).select("track", F.col("name").alias("chord")), "track")
    features = features.join(peaks.select("track", "bpm", F.col("phase").alias("peak_phase"), F.col("f").alias("peak_freq")), "track").join(rollups.consonance(amps, TRACK, 0.9), "track")
    features = features.join(found.groupBy("track").agg(F.count("*").alias("n_companions")), "track", "left").fillna(0, ["n_companions"]).withColumn("t", F.lit(0.5))
    listed = _voice_banks(spark, sf).select("track", F.col("cluster").cast("long").alias("voice"), F.col("rhythm.bpm").alias("rhythm_bpm"), F.col("motor.bpm").alias("motor_bpm"))
    return messages.feature_lines(features, listed, TRACK)


# --- MIDI, forwarding, control changes -------------------------------------------------------


@query("WITH t AS (SELECT user_id, min(epoch(ts)) AS first, max(epoch(ts)) AS last, 30 + min(event_id) % 90 AS bpm FROM events WHERE ts IS NOT NULL GROUP BY user_id) SELECT user_id, CAST(k AS BIGINT) AS tick, round(k * 60e0 / (bpm * 24), 6) + 0e0 AS at FROM t, range(0, 240) x(k) WHERE last > first AND bpm % 7 <> 0 AND k < ceil(5e0 / (60e0 / (bpm * 24)))")
def midi_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-four ticks a beat over the first five seconds of each user's span; every seventh tempo is no tempo."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    t = e.groupBy("user_id").agg((F.max("ts") > F.min("ts")).alias("some"), (30 + F.min("event_id") % 90).alias("bpm"))
    t = t.select("user_id", F.lit(0.0).alias("start"), F.when(F.col("some"), 5.0).otherwise(0.0).alias("end"), F.when(F.col("bpm") % 7 != 0, F.col("bpm")).alias("bpm"))
    return rounded(messages.clock_messages(t, ["user_id"]))


@query(f"""WITH {STATE}, h AS (SELECT track, frame, list_sort(list_distinct(list(CAST(osc % 12 AS INTEGER)) FILTER (amp > 0.25e0))) AS notes FROM st GROUP BY ALL),
b AS (SELECT track, frame, coalesce(notes, []) AS now, coalesce(lag(notes) OVER (PARTITION BY track ORDER BY frame), []) AS prev FROM h),
e AS (SELECT track, frame, 'note_off' AS type, unnest(list_sort(list_filter(prev, lambda x: NOT list_contains(now, x)))) AS pc FROM b UNION ALL SELECT track, frame, 'note_on', unnest(list_sort(list_filter(now, lambda x: NOT list_contains(prev, x)))) FROM b)
SELECT track, frame AS seq, CAST(row_number() OVER (PARTITION BY track, frame ORDER BY type, pc) - 1 AS INTEGER) AS place, type, 0 AS channel, pc + 60 AS note, CASE WHEN type = 'note_on' THEN 96 ELSE 0 END AS velocity FROM e""")
def midi_notes(spark: SparkSession, sf: str) -> DataFrame:
    on = F.when(F.col("amp") > 0.25, (F.col("osc") % 12).cast("int"))
    h = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.array_sort(F.collect_set(on)).alias("notes"))
    return messages.chord_notes(h.withColumnRenamed("frame", "seq"), TRACK)


@query(f"""WITH {MESSAGES} SELECT seq, 7 AS channel, CAST(greatest(0, least(127, trunc(value))) AS INTEGER) AS value FROM msg WHERE address LIKE '/voice/%/amp'""")
def midi_controls(spark: SparkSession, sf: str) -> DataFrame:
    return messages.control_changes(messages.route(views.messages(spark, sf), _rules(spark)))


@query(f"WITH {MESSAGES}, ends AS (SELECT event_type AS host, user_id % 3 AS port, min(event_id) AS first FROM events GROUP BY ALL), e AS (SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS place, host, port FROM ends) SELECT host, port, place, address, CAST(count(*) AS BIGINT) AS n FROM msg, e GROUP BY ALL")
def forwarded(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("host"), (F.col("user_id") % 3).alias("port"))
    return messages.forward(views.messages(spark, sf), e).groupBy("host", "port", "place", "address").agg(F.count("*").alias("n"))


# --- logs and weights ------------------------------------------------------------------------


@query(f"WITH {STATE} SELECT CAST(track AS VARCHAR) AS track, {r('frame / 60e0')} AS t, {r('sum(CAST(CAST(amp AS FLOAT) AS DOUBLE))')} AS energy, 0e0 AS residual FROM st GROUP BY track, frame")
def state_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One layer of a written log of two; files without residuals give zeros."""
    s = views.osc_state(spark, sf)
    row = F.array_sort(F.collect_list(F.struct("osc", "re", "im", "amp", "phase")))
    of = lambda c: F.transform("__r", lambda x: x[c].cast("float"))
    log = s.groupBy("track", "frame").agg(row.alias("__r")).select(F.col("track").cast("string").alias("track"), (F.col("frame") / 60.0).alias("t"), of("re").alias("z_real"), of("im").alias("z_imag"), of("amp").alias("amp"), of("phase").alias("phase"), of("amp").alias("drive"), F.lit(None).cast("array<float>").alias("residual"), F.transform("__r", lambda x: x["amp"] > 0.2).alias("phantom"))
    path = work_folder(spark, "log")
    files.write_state_log(log.withColumn("layer", F.lit("pitch")).unionByName(log.withColumn("layer", F.lit("rhythm"))), path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(files.scan_state_log(spark, path, "pitch").select(F.col("track").cast("string").alias("track"), "t", total("amp").alias("energy"), total("residual").alias("residual")))


@query(f"WITH {WEIGHTS} SELECT CAST(track AS VARCHAR) AS track, k / 2e0 AS t, CAST(count(*) AS BIGINT) AS n, {r('sum(re * (k + 1))')} AS total FROM w, range(3) x(k) WHERE k = 2 GROUP BY ALL")
def weights_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three snapshots of the weights written and read back, the last one taken."""
    w = _weights(_last_frame(spark, sf))
    rows = w.select(F.col("track").cast("string").alias("track"), F.lit("pitch").alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "i", "j", "re", "im")
    path = work_folder(spark, "weights")
    files.write_weights(rows.select("track", "layer", (F.col("k") / 2.0).alias("t"), "i", "j", (F.col("re") * (F.col("k") + 1)).alias("re"), "im"), path)
    last = files.final_weights(files.scan_weights(spark, path, "pitch"))
    return rounded(last.groupBy(F.col("track").cast("string").alias("track"), "t").agg(F.count("*").alias("n"), F.sum("re").alias("total")))


@query(f"WITH {STATE}, ts AS (SELECT DISTINCT track, frame / 60e0 AS t FROM st), k AS (SELECT track, floor(t * 7 + 1e-9) AS tick, min(t) AS t FROM ts GROUP BY ALL), f AS (SELECT track, t FROM k WHERE t - tick / 7e0 < 1 / 60e0) SELECT track, {r('t')} AS t FROM (SELECT * FROM f UNION SELECT track, max(t) FROM ts WHERE track IN (SELECT track FROM f) GROUP BY track)")
def weight_cadence(spark: SparkSession, sf: str) -> DataFrame:
    times = views.osc_state(spark, sf).select("track", (F.col("frame") / 60.0).alias("t")).distinct()
    return rounded(signals.cadence(times, TRACK, 7.0, 1 / 60))


@query(f"WITH {WEIGHTS}, bank AS (SELECT CAST(o AS INTEGER) AS osc, 110e0 * pow(2e0, o / 12e0) AS f FROM range(32) t(o)) SELECT w.track, w.i, w.j, {r('sqrt(re * re + im * im)')} AS magnitude FROM w JOIN bank a ON a.osc = w.i JOIN bank b ON b.osc = w.j WHERE w.i < w.j AND {harmonic_sql('b.f', 'a.f')}")
def weight_guides(spark: SparkSession, sf: str) -> DataFrame:
    bank = dims.banks(spark).select("osc", F.col("pitch_f").alias("f"))
    return rounded(reports.guide_pairs(_weights(_last_frame(spark, sf)), bank))


@query(f"""WITH {STATE}, amps AS (SELECT track, osc, 110e0 * pow(2e0, osc / 12e0) AS pf, 0.5e0 * pow(20e0, osc / 31e0) AS rf, avg(amp) AS amp FROM st GROUP BY ALL), {extractors_sql("track", 0.9)}
SELECT track, tonic, mode, {r("key_confidence")} AS confidence FROM key_""")
def weight_key(spark: SparkSession, sf: str) -> DataFrame:
    """The key from the diagonal of a weight table, here the mean amplitudes."""
    amps = rollups.mean_amp(views.osc_state(spark, sf), TRACK)
    diagonal = amps.select("track", F.col("osc").alias("i"), F.col("osc").alias("j"), F.col("amp").alias("re"), F.lit(0.0).alias("im"))
    return rounded(rollups.detect_key(spark, rollups.weights_chroma(diagonal), TRACK))


@query(f"""WITH {STATE}, s AS (SELECT track, CAST(count(DISTINCT frame) AS BIGINT) AS n, CAST(avg(amp) AS DECIMAL(18, 6)) AS mean, CAST(max(amp) AS DECIMAL(18, 6)) AS most FROM st GROUP BY track)
SELECT track, '{{"n_snapshots":' || n || ',"amp_mean":' || mean || ',"amp_max":' || most || '}}' AS json FROM s""")
def baseline_json(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf).withColumn("phantom", F.lit(False))
    fixed = rollups.summary(s, TRACK).select("track", "n_snapshots", F.col("amp_mean").cast("decimal(18,6)").alias("amp_mean"), F.col("amp_max").cast("decimal(18,6)").alias("amp_max"))
    return reports.baseline_json(fixed, TRACK)


# --- the engine ------------------------------------------------------------------------------

DAY_ENGINE = EngineConfig(rate=24.0, channels=(1.0, 2.0, 4.0), pitch=tuple(2.0 ** (k / 2) for k in range(6)), rhythm=tuple(BANK[::4]), span=6, motor=True, forward=0.4, backward=0.2, pitch_bank=BankConfig(learn_rate=0.5, weight_decay=0.1))


@query()
def engine_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Cochlea, drives and three coupled banks over hourly samples, a snapshot four times a day."""
    found = engine.snapshots(_tracks(spark, sf).withColumnRenamed("drive", "x"), DAY_ENGINE)
    flat = found.select("track", "frame", "layer", F.posexplode(F.arrays_zip("re", "im")).alias("osc", "z"))
    return rounded(flat.select("track", "frame", "layer", "osc", "z.re", "z.im"))


@query(f"WITH {STATE}, p AS (SELECT track, frame, sum(amp) AS energy FROM st GROUP BY ALL), m AS (SELECT track, frame, sum(amp) / 2 AS motor FROM st WHERE track < 5 GROUP BY ALL) SELECT track, frame, {r('energy')} AS energy, {r('motor')} AS motor, motor IS NOT NULL AS has_motor FROM p LEFT JOIN m USING (track, frame)")
def optional_layer(spark: SparkSession, sf: str) -> DataFrame:
    """A layer that some tracks lack: null where it is missing."""
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    motor = e.where("track < 5").select("track", "frame", (F.col("energy") / 2).alias("motor"))
    return rounded(e.join(motor, ["track", "frame"], "left").withColumn("has_motor", F.col("motor").isNotNull()))


FEATURES = {"tempo": "bpm", "tempo_confidence": "tempo_confidence", "key_confidence": "key_confidence", "chord_confidence": "chord_confidence", "consonance": "consonance"}


@query(f"""WITH {AMPS}, {extractors_sql("track", 0.9)}, f AS (SELECT * FROM key_ JOIN chord_ USING (track) JOIN tempo_ USING (track) JOIN cons_ USING (track))
SELECT track, '/features/key' AS address, tonic AS arg, CAST(NULL AS DOUBLE) AS value FROM f UNION ALL SELECT track, '/features/mode', mode, NULL FROM f UNION ALL SELECT track, '/features/chord', chord, NULL FROM f WHERE track % 2 = 0
UNION ALL """ + " UNION ALL ".join(f"SELECT track, '/features/{k}', NULL, {r(v)} FROM f" for k, v in FEATURES.items()))
def feature_osc_messages(spark: SparkSession, sf: str) -> DataFrame:
    """All features as messages; tracks with odd numbers have no chord, and no message for it."""
    amps = rollups.mean_amp(views.osc_state(spark, sf), TRACK)
    line = windows.timeline(amps.withColumn("win", F.lit(0)), ["track", "win"], share=0.9).withColumn("chord", F.when(F.col("track") % 2 == 0, F.col("chord")))
    names = {"tonic": "key", "mode": "mode", "chord": "chord"} | {v: k for k, v in FEATURES.items()}
    sent = messages.feature_messages(line, TRACK, names)
    text = F.col("address").isin("/features/key", "/features/mode", "/features/chord")
    return rounded(sent.select("track", "address", F.when(text, F.col("arg")).alias("arg"), F.when(~text, F.col("arg").try_cast("double")).alias("value")))


# --- clocks ----------------------------------------------------------------------------------


@query(f"WITH {SIGNAL}, ch AS (SELECT channel, max(abs(env)) AS most FROM sig GROUP BY channel), tr AS (SELECT CAST(dense_rank() OVER (ORDER BY s.channel) AS BIGINT) AS track, s.n, s.env / greatest(c.most, 1e-9) AS drive FROM sig s JOIN ch c USING (channel)) SELECT track, CAST(floor(n / 24e0 / 0.15e0 + 1e-9) AS BIGINT) AS n, {r('drive')} AS drive FROM tr WHERE floor(n / 24e0 / 0.15e0 + 1e-9) > floor((n - 1) / 24e0 / 0.15e0 + 1e-9)")
def slower_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The samples that a bank hears which steps every 0.15 days, under hourly samples."""
    return rounded(dynamics.clocked(_tracks(spark, sf), 24.0, 0.15))


@query()
def motor_batched(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dynamics.simulate_coupled(_tracks(spark, sf), BANK, BankConfig(), 0.4, 0.2, 24, batch=8))
