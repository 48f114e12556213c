"""The queries over the supplied tables, each with its SQL for DuckDB where SQL can express it.

Numbers are rounded to six digits, so that the order of additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.functions import music, routing
from resonant.functions.common import let, tidy
from resonant.operators import dynamics, messages, pairs, reports, rhythm, rollups, signals, voices, windows
from resonant.plans import dims
from resonant.plans.config import BankConfig, OscillatorParams, VoiceConfig
from resonant.sources import synth, views
from resonant.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TRACK = ["track"]
CLUSTERING = VoiceConfig(correlation=0.3)
PARAMS = OscillatorParams()
DAY_BANK = (0.25, 4.0, 16)  # cycles a day, for hourly steps
DT = 1 / 24
RULES = [
    (0, "/voice/*/rhythm/phase", "cv/0", "phase_to_sawtooth"),
    (1, "/voice/*/amp", "midi/cc/7", "passthrough"),
    (2, "/voice/3/amp", "cv/1", "unit_to_5v"),
    (3, "/features/click", "cv/2", "nothing_of_this_name"),
    (4, "/features/view", "cv/x", "passthrough"),
    (5, "/features/*", "midi/clock", "unit_to_5v"),
    (6, "/features", "cv/3", "passthrough"),
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Every double column tidied."""
    return df.select(*[tidy(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- pieces of SQL ---------------------------------------------------------------------------


def r(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def literal(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows) + ")"


STATE = """frames AS (
  SELECT CAST(label AS BIGINT) AS track, embedding AS e,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame FROM embeddings
), parts AS (
  SELECT track, frame, CAST(o AS INTEGER) AS osc, CAST(e[o + 1] AS DOUBLE) AS re, CAST(e[o + 33] AS DOUBLE) AS im
  FROM frames, range(32) t(o)
), st AS (
  SELECT *, sqrt(re * re + im * im) AS amp, atan2(im, re) AS phase,
         110e0 * pow(2e0, osc / 12e0) AS pf, 0.5e0 * pow(20e0, osc / 31e0) AS rf FROM parts
)"""
AMPS = STATE + ", amps AS (SELECT track, osc, pf, rf, avg(amp) AS amp FROM st GROUP BY ALL)"
CHROMA = AMPS + """, pcs AS (
  SELECT track, CAST(((round_even(12 * log2(pf / 440) + 9, 0) % 12) + 12) % 12 AS INTEGER) AS pc, amp FROM amps
), chroma AS (
  SELECT t.track, CAST(k AS INTEGER) AS pc, coalesce(sum(p.amp), 0e0) AS energy
  FROM (SELECT DISTINCT track FROM amps) t CROSS JOIN range(12) x(k) LEFT JOIN pcs p ON p.track = t.track AND p.pc = k
  GROUP BY t.track, k
)"""
SIGNAL = """sums AS (
  SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type AS channel, sum(value) AS env
  FROM events WHERE ts IS NOT NULL GROUP BY ALL
), bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM sums),
sig AS (
  SELECT h - lo AS n, c.channel, coalesce(s.env, 0e0) AS env
  FROM bounds, range(lo, hi + 1) t(h) CROSS JOIN (SELECT DISTINCT channel FROM sums) c
  LEFT JOIN sums s ON s.hour = h AND s.channel = c.channel
), rises AS (
  SELECT n, coalesce(greatest(0e0, env - lag(env) OVER (ORDER BY n)), 0e0) AS rise
  FROM (SELECT n, sum(env) AS env FROM sig GROUP BY n)
), drv AS (SELECT n, rise / ((SELECT max(rise) FROM rises) + 1e-9) AS drive FROM rises)"""
VOICE_FRAMES = """grouped AS (
  SELECT user_id % 50 AS voice, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, min(event_id % 36) AS st12, avg(value) AS amp
  FROM events WHERE ts IS NOT NULL GROUP BY ALL
), vf AS (
  SELECT CAST(0 AS BIGINT) AS track, hour - (SELECT min(hour) FROM grouped) AS frame, voice,
         110e0 * pow(2e0, st12 / 12e0) AS freq, amp FROM grouped
)"""
TRIGGERS = """trg AS (
  SELECT o_orderkey AS trigger, CAST(0 AS BIGINT) AS track, o_custkey % 600 AS first, o_custkey % 600 + o_orderkey % 20 AS last,
         110e0 * pow(2e0, (o_orderkey % 36) / 12e0) AS freq, (o_custkey % 10) / 10e0 AS velocity FROM orders
)"""
MESSAGES = """msg AS (
  SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '/features/' || event_type
    ELSE '/voice/' || CAST(user_id % 10 AS VARCHAR) || CASE WHEN event_id % 3 = 1 THEN '/rhythm/phase' ELSE '/amp' END END AS address,
    value FROM events
)"""
RULE_SQL = values("rules", "seq, source, output, scale", RULES)


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def harmonic_sql(a: str, b: str) -> str:
    at = f"abs(12 * log2({a} / {b}))"
    return "(" + " OR ".join(f"abs({at} - 12 * log2({p}e0 / {q}e0)) <= 0.5e0" for p, q in dims.HARMONIC_RATIOS) + ")"


def consonance_sql(ratio: str) -> str:
    spread = 2 * dims.CONSONANCE_SIGMA**2
    return "greatest(" + ", ".join(f"{s!r}e0 * exp(-pow(12 * log2({ratio}) - 12 * log2({p}e0 / {q}e0), 2) / {spread!r}e0)" for p, q, s in dims.CONSONANCES) + ")"


def plv_sql(turn: str) -> str:
    return f"sqrt(pow(avg(cos({turn})), 2) + pow(avg(sin({turn})), 2))"


# --- state log and grids ---------------------------------------------------------------------


@query(f"WITH {STATE} SELECT track, frame, {r('frame / 60e0')} AS t, osc, {r('re')} AS re, {r('im')} AS im, {r('amp')} AS amp, {r('phase')} AS phase FROM st")
def state_log_project(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    return rounded(s.select("track", "frame", (F.col("frame") / 60.0).alias("t"), "osc", "re", "im", "amp", "phase"))


@query(f"WITH {STATE}, log AS (SELECT track, frame, 'pitch' AS layer, amp FROM st UNION ALL SELECT track, frame, 'rhythm', amp / 2 FROM st) SELECT track, frame, layer, {r('sum(amp)')} AS energy FROM log WHERE layer = 'pitch' GROUP BY track, frame, layer")
def layer_scan(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    log = s.select("track", "frame", F.lit("pitch").alias("layer"), "amp").unionByName(s.select("track", "frame", F.lit("rhythm").alias("layer"), (F.col("amp") / 2).alias("amp")))
    return rounded(log.where("layer = 'pitch'").groupBy("track", "frame", "layer").agg(F.sum("amp").alias("energy")))


@query(f"SELECT CAST(k AS BIGINT) AS k, {r('440e0 * pow(2e0, k / 24e0)')} AS f FROM range(CAST(floor(24 * log2(30e0 / 440e0)) AS BIGINT), CAST(ceil(24 * log2(4000e0 / 440e0)) AS BIGINT) + 1) t(k)")
def tet_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dims.tempered_bank(spark, 30.0, 4000.0, 2))


@query(f"WITH c AS (SELECT 9.26449e0 * 24.7e0 AS s), b AS (SELECT s, 9.26449e0 * ln(1 + 30e0 / s) AS lo, 9.26449e0 * ln(1 + 4000e0 / s) AS hi FROM c) SELECT CAST(k AS INTEGER) AS channel, {r('s * (exp((lo + (hi - lo) * k / 63e0) / 9.26449e0) - 1)')} AS fc FROM b, range(64) t(k)")
def erb_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dims.erb_bank(spark, 30.0, 4000.0, 64))


@query(f"SELECT CAST(k AS INTEGER) AS osc, {r('30e0 * pow(4000e0 / 30e0, k / 99e0)')} AS f FROM range(100) t(k)")
def geom_bank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dims.geometric_bank(spark, 30.0, 4000.0, 100))


@query(f"""WITH c AS (SELECT 9.26449e0 * 24.7e0 AS s), b AS (SELECT s, 9.26449e0 * ln(1 + 100e0 / s) AS lo, 9.26449e0 * ln(1 + 2000e0 / s) AS hi FROM c),
ch AS (SELECT CAST(k AS INTEGER) AS channel, s * (exp((lo + (hi - lo) * k / 15e0) / 9.26449e0) - 1) AS fc FROM b, range(16) t(k)),
bank AS (SELECT CAST(k AS INTEGER) AS osc, 30e0 * pow(4000e0 / 30e0, k / 59e0) AS f FROM range(60) t(k)),
p AS (SELECT osc, channel, abs(ln(f) - ln(fc)) AS d, exp(-pow((ln(f) - ln(fc)) * 15, 2)) AS g FROM bank, ch),
w AS (SELECT *, sum(g) OVER (PARTITION BY osc) AS total, row_number() OVER (PARTITION BY osc ORDER BY d, channel) AS near FROM p)
SELECT osc, channel, {r("CASE WHEN total < 1e-9 THEN CASE WHEN near = 1 THEN 1e0 ELSE 0e0 END ELSE g / total END")} AS w FROM w""")
def channel_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.channel_weights(dims.erb_bank(spark, 100.0, 2000.0, 16), dims.geometric_bank(spark, 30.0, 4000.0, 60)))


# --- scalar functions ------------------------------------------------------------------------


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("hz")).where("hz > 0")


@query("SELECT o_orderkey, CAST(((round_even(12 * log2(o_totalprice / 440) + 9, 0) % 12) + 12) % 12 AS INTEGER) AS pc FROM orders WHERE o_totalprice > 0")
def pitch_class(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("o_orderkey", music.pitch_class(F.col("hz")).alias("pc"))


@query("""WITH a AS (SELECT o_orderkey, 12 * log2(o_totalprice / 440) AS s FROM orders WHERE o_totalprice > 0),
b AS (SELECT o_orderkey, CAST(round_even(s, 0) AS INTEGER) AS k, s FROM a), c AS (SELECT *, CAST(round_even((s - k) * 100, 0) AS INTEGER) AS cents FROM b)
SELECT o_orderkey, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[(((k + 69) % 12) + 12) % 12 + 1] || CAST(CAST(floor((k + 69) / 12e0) AS INTEGER) - 1 AS VARCHAR)
  || CASE WHEN cents >= 0 THEN '+' ELSE '' END || CAST(cents AS VARCHAR) AS note FROM c""")
def note_name(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("o_orderkey", music.note_name(F.col("hz")).alias("note"))


@query(f"WITH b AS (SELECT CAST(k AS INTEGER) AS osc, 30e0 * pow(4000e0 / 30e0, k / 99e0) AS f FROM range(100) t(k)) SELECT a.osc AS i, c.osc AS j FROM b a JOIN b c ON a.osc < c.osc WHERE {harmonic_sql('c.f', 'a.f')}")
def harmonic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.harmonic_pairs(dims.geometric_bank(spark, 30.0, 4000.0, 100))


@query(f"SELECT o_orderkey, {r(consonance_sql('(1 + (o_custkey % 1000) / 1000e0)'))} AS score FROM orders")
def ratio_consonance(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return rounded(orders.select("o_orderkey", music.ratio_consonance(1 + (F.col("o_custkey") % 1000) / 1000.0).alias("score")))


@query(f"""SELECT event_id, {r("(value + pi()) / (2 * pi()) * 5 - floor((value + pi()) / (2 * pi())) * 5")} AS saw, {r("greatest(0e0, least(5e0, 5 * value))")} AS unit,
{r("value")} AS plain, {r("4 + (event_id % 12) / 12e0")} AS tonic, CAST(NULL AS DOUBLE) AS unknown FROM events""")
def cv_scale(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").cast("string").alias("arg"))
    tonic = music.pitch_class_name((F.col("event_id") % 12).cast("int"))
    return rounded(e.select("event_id", routing.sawtooth(F.col("arg")).alias("saw"), routing.unit_volts(F.col("arg")).alias("unit"), routing.number(F.col("arg")).alias("plain"), routing.volts_of_tonic(tonic).alias("tonic"), routing.volts_of_tonic(F.lit("H")).cast("double").alias("unknown")))


@query(f"WITH {STATE} SELECT track, frame, osc, coalesce(phase < lag(phase) OVER (PARTITION BY track, osc ORDER BY frame) - pi() / 2, false) AS wrapped FROM st")
def phase_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return windows.phase_wrapped(views.osc_state(spark, sf)).select("track", "frame", "osc", "wrapped")


@query(f"""WITH {MESSAGES}, {RULE_SQL}, met AS (
  SELECT m.seq, m.address, m.value, u.output, u.scale, split_part(u.output, '/', 1) AS kind,
    CASE WHEN u.output LIKE 'midi/cc/%' THEN TRY_CAST(substr(u.output, 9) AS INTEGER) WHEN u.output LIKE 'cv/%' THEN TRY_CAST(substr(u.output, 4) AS INTEGER) END AS channel
  FROM msg m JOIN rules u ON regexp_full_match(m.address, replace(u.source, '*', '[^/]*'))
) SELECT seq, address, kind, channel, {r('''CASE scale WHEN 'phase_to_sawtooth' THEN 5 * ((value + pi()) / (2 * pi()) - floor((value + pi()) / (2 * pi())))
  WHEN 'unit_to_5v' THEN greatest(0e0, least(5e0, 5 * value)) ELSE value END''')} AS value
FROM met WHERE value IS NOT NULL AND (channel IS NOT NULL OR output = 'midi/clock')""")
def osc_glob_route(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(messages.route(views.messages(spark, sf), _rules(spark)))


def _rules(spark: SparkSession) -> DataFrame:
    return dims.table(spark, "seq, source, output, scale", RULES)


@query(f"WITH {STATE} SELECT track, frame, osc, amp > 0.15e0 AND abs(re) < 0.05e0 AS phantom, {r('abs(re * 1e0) - 0.1e0 * amp')} AS residual, {r('CASE WHEN 8 * amp > 0.98e0 THEN 0.98e0 ELSE 8 * amp END')} AS held FROM st")
def phantom_residual(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    z = dynamics.cut(F.struct((8 * F.col("re")).alias("re"), (8 * F.col("im")).alias("im")), PARAMS)
    held = let(z, lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]))
    return rounded(s.select("track", "frame", "osc", dynamics.phantom(F.col("amp"), F.abs("re"), 0.15, 0.05).alias("phantom"), dynamics.residual(F.col("re"), F.col("amp"), PARAMS).alias("residual"), held.alias("held")))


# --- rollups ---------------------------------------------------------------------------------


@query(f"WITH {AMPS} SELECT track, osc, {r('amp')} AS amp FROM amps")
def mean_amp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.mean_amp(views.osc_state(spark, sf), TRACK))


def _amps(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.mean_amp(views.osc_state(spark, sf), TRACK)


@query(f"WITH {CHROMA} SELECT track, pc, {r('energy')} AS energy FROM chroma")
def chroma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.chroma(_amps(spark, sf), TRACK))


@query(f"WITH {STATE} SELECT track, osc, {r('CASE WHEN sum(amp) > 0 THEN atan2(sum(amp * sin(phase)), sum(amp * cos(phase))) ELSE 0e0 END')} AS phase FROM st GROUP BY track, osc")
def circular_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.circular_mean(views.osc_state(spark, sf), ["track", "osc"]))


@query(f"WITH {STATE} SELECT track, CAST(count(DISTINCT frame) AS BIGINT) AS n_snapshots, CAST(count(DISTINCT osc) AS BIGINT) AS n_oscillators, {r('avg(amp)')} AS amp_mean, {r('max(amp)')} AS amp_max, {r('quantile_cont(amp, 0.5)')} AS amp_p50, {r('quantile_cont(amp, 0.95)')} AS amp_p95, {r('avg(CASE WHEN amp > 0.15e0 AND abs(re) < 0.05e0 THEN 1e0 ELSE 0e0 END)')} AS phantom_fraction FROM st GROUP BY track")
def state_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf).withColumn("phantom", dynamics.phantom(F.col("amp"), F.abs("re"), 0.15, 0.05))
    return rounded(rollups.summary(s, TRACK))


@query(f"WITH {STATE}, p AS (SELECT track, osc, max(amp) AS peak FROM st GROUP BY ALL), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY track ORDER BY peak DESC, osc DESC) AS INTEGER) AS place FROM p) SELECT track, place, osc, {r('peak')} AS peak FROM q WHERE place <= 5")
def top5_osc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.strongest(views.osc_state(spark, sf), TRACK))


@query(f"""WITH {AMPS}, near AS (SELECT *, lag(amp) OVER w AS a, lead(amp) OVER w AS c, row_number() OVER (PARTITION BY track ORDER BY amp DESC, osc) AS place,
  avg(amp) OVER (PARTITION BY track) AS mean FROM amps WINDOW w AS (PARTITION BY track ORDER BY osc)),
p AS (SELECT *, greatest(-0.5e0, least(0.5e0, coalesce(0.5e0 * (a - c) / nullif(a - 2 * amp + c, 0), 0e0))) AS d FROM near WHERE place = 1)
SELECT track, {r("60 * CASE WHEN a IS NULL OR c IS NULL THEN rf ELSE exp(ln(rf) + d * (ln(0.5e0 * pow(20e0, (osc + 1) / 31e0)) - ln(0.5e0 * pow(20e0, (osc - 1) / 31e0))) / 2) END")} AS bpm,
  {r("greatest(0e0, least(1e0, (amp - mean) / amp))")} AS confidence FROM p""")
def tempo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.tempo(_amps(spark, sf), TRACK))


KEY_ROWS = [(12 * m + t, dims.PITCH_CLASSES[t], mode, (t + k) % 12, w) for m, (mode, p) in enumerate(dims.KEY_PROFILES.items()) for t in range(12) for k, w in enumerate(p)]
CHORD_ROWS = [(12 * m + t, dims.PITCH_CLASSES[t], q, dims.PITCH_CLASSES[t] + dims.CHORD_SUFFIXES[q], pc, float((pc - t) % 12 in tones)) for m, (q, tones) in enumerate(dims.CHORD_TONES.items()) for t in range(12) for pc in range(12)]


def template_sql(columns: str, rows: list[tuple], labels: str) -> str:
    return f"""WITH {CHROMA}, {values("tpl", f"seq, {columns}, pc, weight", rows)},
sc AS (SELECT track, seq, {labels}, {corr_sql("energy", "weight")} AS score FROM chroma JOIN tpl USING (pc) GROUP BY ALL),
ag AS (SELECT track, max(score) AS top, median(score) AS middle FROM sc GROUP BY track),
best AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, seq) AS place FROM sc)
SELECT track, {labels}, {r("greatest(0e0, least(1e0, (top - middle) / 0.5e0))")} AS confidence FROM best JOIN ag USING (track) WHERE place = 1"""


@query(template_sql("tonic, mode", KEY_ROWS, "tonic, mode"))
def key_detect(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.detect_key(spark, rollups.chroma(_amps(spark, sf), TRACK), TRACK))


@query(template_sql("root, quality, name", CHORD_ROWS, "root, quality, name"))
def chord_detect(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.detect_chord(spark, rollups.chroma(_amps(spark, sf), TRACK), TRACK))


@query(f"""WITH {AMPS}, act AS (SELECT * FROM (SELECT *, max(amp) OVER (PARTITION BY track) AS top FROM amps) WHERE amp > 0.9e0 * top),
p AS (SELECT a.track, a.amp * b.amp AS w, {consonance_sql("b.pf / a.pf")} AS s FROM act a JOIN act b ON a.track = b.track AND a.osc < b.osc)
SELECT t.track, {r("coalesce(sum(w * s) / nullif(sum(w), 0), 0e0)")} AS consonance FROM (SELECT DISTINCT track FROM amps) t LEFT JOIN p USING (track) GROUP BY t.track""")
def consonance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.consonance(_amps(spark, sf), TRACK, 0.9))


# --- pairs -----------------------------------------------------------------------------------

LOCKS = values("ratios", "p, q", dims.LOCK_RATIOS)


@query(f"""WITH {STATE}, {LOCKS} SELECT a.track, a.osc AS i, b.osc AS j, p, q, {r(plv_sql("q * a.phase - p * b.phase"))} AS plv
FROM st a JOIN st b ON a.track = b.track AND a.frame = b.frame AND a.osc < b.osc CROSS JOIN ratios GROUP BY ALL HAVING {plv_sql("q * a.phase - p * b.phase")} >= 0.3e0""")
def plv_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.mode_locks(spark, views.osc_state(spark, sf), TRACK, 0.3))


@query(f"""WITH {STATE}, {LOCKS}, act AS (SELECT track, osc FROM st GROUP BY ALL HAVING avg(amp) > 0.16e0), s AS (SELECT * FROM st SEMI JOIN act USING (track, osc))
SELECT a.track, a.osc AS i, b.osc AS j, p, q, {r(plv_sql("q * a.phase - p * b.phase"))} AS plv
FROM s a JOIN s b ON a.track = b.track AND a.frame = b.frame AND a.osc < b.osc CROSS JOIN ratios GROUP BY ALL HAVING {plv_sql("q * a.phase - p * b.phase")} >= 0.2e0""")
def mode_locks_active(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    return rounded(pairs.mode_locks(spark, s, TRACK, 0.2, active=pairs.active_oscillators(s, TRACK, 0.16)))


def corr_cte(source: str = "st") -> str:
    return f"""cr AS (SELECT track, i, j, CASE WHEN near THEN least(1e0, c + 0.15e0) ELSE c END AS corr FROM (
  SELECT a.track, a.osc AS i, b.osc AS j, any_value({harmonic_sql("b.pf", "a.pf")}) AS near,
    coalesce({corr_sql("a.amp", "b.amp")}, CASE WHEN stddev_pop(a.amp) = 0 AND stddev_pop(b.amp) = 0 THEN 1e0 ELSE 0e0 END) AS c
  FROM {source} a JOIN {source} b ON a.track = b.track AND a.frame = b.frame AND a.osc < b.osc GROUP BY a.track, a.osc, b.osc))"""


@query(f"WITH {STATE}, {corr_cte()} SELECT track, i, j, {r('corr')} AS corr FROM cr")
def envelope_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.envelope_correlation(views.osc_state(spark, sf), TRACK))


CLUSTERS = f"""{STATE}, act AS (SELECT track, osc FROM (SELECT track, osc, avg(amp) AS m, max(avg(amp)) OVER (PARTITION BY track) AS top FROM st GROUP BY track, osc) WHERE m > 0.02e0 AND m > 0.08e0 * top),
kept AS (SELECT * FROM st SEMI JOIN act USING (track, osc)), {corr_cte("kept")},
edges AS (SELECT track, i AS a, j AS b FROM cr WHERE corr > 0.3e0 UNION SELECT track, j, i FROM cr WHERE corr > 0.3e0 UNION SELECT track, osc, osc FROM act),
reach AS (SELECT track, a, b FROM edges UNION SELECT r.track, r.a, e.b FROM reach r JOIN edges e ON r.track = e.track AND r.b = e.a),
members AS (SELECT track, min(b) AS cluster, a AS osc FROM reach GROUP BY track, a)"""


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = views.osc_state(spark, sf)
    return s, voices.clusters(s, TRACK, CLUSTERING)


@query(f"WITH RECURSIVE {CLUSTERS} SELECT track, cluster, osc FROM members")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf)[1]


@query(f"""WITH RECURSIVE {CLUSTERS}, each AS (SELECT m.track, m.cluster, m.osc, s.pf, avg(s.amp) AS a, max_by(s.phase, s.frame) AS p FROM members m JOIN st s USING (track, osc) GROUP BY ALL),
inside AS (SELECT c.track, x.cluster, avg(c.corr) AS c FROM cr c JOIN members x ON x.track = c.track AND x.osc = c.i JOIN members y ON y.track = c.track AND y.osc = c.j AND y.cluster = x.cluster GROUP BY ALL),
t AS (SELECT track, cluster, count(*) AS size, exp(sum(a * ln(pf)) / sum(a)) AS centre, avg(a) AS amp, atan2(sum(a * sin(p)), sum(a * cos(p))) AS phase FROM each GROUP BY ALL)
SELECT t.track, t.cluster, CAST(size AS BIGINT) AS size, {r("centre")} AS centre, {r("amp")} AS amp, {r("phase")} AS phase, {r("greatest(0e0, least(1e0, coalesce(i.c, 1e0)))")} AS confidence FROM t LEFT JOIN inside i USING (track, cluster)""")
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    found = voices.active_correlations(s, TRACK, CLUSTERING)
    members = voices.clusters(s, TRACK, CLUSTERING, found)
    return rounded(voices.cluster_stats(s, members, TRACK, CLUSTERING, found))


@query(f"""WITH RECURSIVE {CLUSTERS}, env AS (SELECT m.track, m.cluster, s.frame, avg(s.amp) AS env FROM members m JOIN st s USING (track, osc) GROUP BY ALL),
cen AS (SELECT * FROM (SELECT *, avg(env) OVER w AS mean, stddev_pop(env) OVER w AS sd, count(*) OVER w AS n, min(frame) OVER w AS first FROM env WINDOW w AS (PARTITION BY track, cluster)) WHERE n >= 8 AND sd >= 1e-6 AND mean > 0),
bank AS (SELECT CAST(o AS INTEGER) AS osc, 0.5e0 * pow(20e0, o / 31e0) AS f FROM range(32) t(o)),
sp AS (SELECT track, cluster, osc, f, sqrt(pow(avg((env - mean) * cos(2 * pi() * f * (frame - first) / 20e0)), 2) + pow(avg((env - mean) * sin(2 * pi() * f * (frame - first) / 20e0)), 2)) AS power
  FROM cen, bank WHERE f BETWEEN 1e0 AND 4e0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY track, cluster ORDER BY power DESC, osc) AS place, avg(power) OVER (PARTITION BY track, cluster) AS mean FROM sp)
SELECT track, cluster, osc, {r("f * 60")} AS bpm, {r("(power - mean) / power")} AS confidence FROM rk WHERE place = 1 AND power > 0""")
def voice_envelope_dft(spark: SparkSession, sf: str) -> DataFrame:
    s, members = _members(spark, sf)
    bank = dims.banks(spark).select("osc", F.col("rhythm_f").alias("f"))
    return rounded(voices.associate(voices.envelopes(s, members, TRACK), bank, TRACK, 20.0))


@query(f"""WITH {STATE}, h AS (SELECT track, frame, list(osc ORDER BY osc) FILTER (amp > 0.2e0) AS m, avg(amp) AS amp, 110e0 + avg(osc) FILTER (amp > 0.2e0) AS f FROM st GROUP BY ALL),
b AS (SELECT *, lag(m) OVER w AS pm, lag(amp) OVER w AS pamp, lag(f) OVER w AS pf FROM h WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, frame, {r("abs(ln(f) - ln(pf)) * 12 / ln(2e0) + 0.3e0 * abs(amp - pamp) + 2 * (1 - len(list_intersect(m, pm)) / CAST(len(list_distinct(list_concat(m, pm))) AS DOUBLE))")} AS cost
FROM b WHERE pm IS NOT NULL AND m IS NOT NULL""")
def jaccard_cost(spark: SparkSession, sf: str) -> DataFrame:
    on = F.when(F.col("amp") > 0.2, F.col("osc"))
    h = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.array_sort(F.collect_list(on)).alias("m"), F.avg("amp").alias("amp"), (110 + F.avg(on)).alias("f"))
    over = Window.partitionBy("track").orderBy("frame")
    b = h.select("*", *[F.lag(c).over(over).alias(f"p{c}") for c in ("m", "amp", "f")]).where("size(pm) > 0 AND size(m) > 0")
    return rounded(b.select("track", "frame", voices.match_cost(F.col("f"), F.col("amp"), F.col("m"), F.col("pf"), F.col("pamp"), F.col("pm")).alias("cost")))


# --- rhythm ----------------------------------------------------------------------------------

BIASED = "exp(-0.5e0 * pow(log2(rf) - 1, 2)) * amp"


@query(f"""WITH {AMPS}, {values("ratios", "seq, p, q", [(k, p, q) for k, (p, q) in enumerate(dims.COMPANION_RATIOS)])},
pk AS (SELECT track, arg_max(osc, ROW({BIASED}, -osc)) AS peak, max(amp) AS top FROM amps GROUP BY track),
aim AS (SELECT *, 0.5e0 * pow(20e0, peak / 31e0) * p / q AS aim FROM pk, ratios),
near AS (SELECT track, seq, p, q, peak, top, arg_min(o, ROW(abs(0.5e0 * pow(20e0, o / 31e0) - aim), o)) AS osc FROM aim, range(32) t(o) WHERE aim BETWEEN 0.5e0 AND 10e0 GROUP BY ALL),
ok AS (SELECT n.* FROM near n JOIN amps a ON a.track = n.track AND a.osc = n.osc WHERE n.osc <> n.peak AND a.amp >= 0.3e0 * n.top),
m AS (SELECT k.track, k.seq, k.p, k.q, CAST(k.osc AS INTEGER) AS osc, count(*) AS n, {plv_sql("k.p * b.phase - k.q * a.phase")} AS plv, max_by(a.phase, a.frame) AS phase
  FROM ok k JOIN st a ON a.track = k.track AND a.osc = k.osc JOIN st b ON b.track = k.track AND b.osc = k.peak AND b.frame = a.frame GROUP BY ALL)
SELECT track, seq, p, q, osc, {r("0.5e0 * pow(20e0, osc / 31e0)")} AS f, {r("phase")} AS phase, {r("plv")} AS plv FROM m WHERE n >= 4 AND plv >= 0.1e0""")
def rhythm_companions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rhythm.companions(spark, views.osc_state(spark, sf), TRACK, least_plv=0.1))


@query(f"""WITH RECURSIVE {STATE}, fr AS (SELECT track, frame, arg_max(osc, ROW({BIASED}, -osc)) AS fresh, max(amp) AS top FROM st GROUP BY ALL),
fold AS (SELECT track, frame, fresh AS peak FROM fr WHERE frame = 0 UNION ALL
  SELECT f.track, f.frame, CASE WHEN s.amp >= 0.8e0 * f.top THEN p.peak ELSE f.fresh END FROM fold p JOIN fr f ON f.track = p.track AND f.frame = p.frame + 1 JOIN st s ON s.track = f.track AND s.frame = f.frame AND s.osc = p.peak)
SELECT track, frame, peak FROM fold""")
def peak_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return rhythm.peak_hysteresis(views.osc_state(spark, sf))


# --- windows ---------------------------------------------------------------------------------


@query(f"WITH {STATE} SELECT track, frame, osc, {r('sqrt(pow(avg(cos(phase)) OVER w, 2) + pow(avg(sin(phase)) OVER w, 2))')} AS coherence FROM st WINDOW w AS (PARTITION BY track, osc ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.rolling_coherence(views.osc_state(spark, sf)).select("track", "frame", "osc", "coherence"))


@query(f"WITH {STATE}, e AS (SELECT track, frame, sum(amp) AS energy FROM st GROUP BY ALL) SELECT track, frame, {r('median(energy) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth FROM e")
def median_smooth(spark: SparkSession, sf: str) -> DataFrame:
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    return rounded(windows.median_smooth(e, "energy", TRACK, "frame").select("track", "frame", "smooth"))


CENTRED = """last AS (SELECT track, max(frame) AS last FROM st GROUP BY track),
win AS (SELECT track, c AS win, greatest(c - 12, 0) AS lo, least(c + 12, last) AS hi FROM last, range(0, last + 1, 6) t(c)),
wa AS (SELECT w.track, w.win, s.osc, s.pf, s.rf, avg(s.amp) AS amp FROM win w JOIN st s ON s.track = w.track AND s.frame BETWEEN w.lo AND w.hi GROUP BY ALL)"""


@query(f"""WITH {STATE}, {CENTRED}, act AS (SELECT * FROM (SELECT *, max(amp) OVER (PARTITION BY track, win) AS top FROM wa) WHERE amp > 0.1e0 * top),
p AS (SELECT a.track, a.win, a.amp * b.amp AS w, {consonance_sql("b.pf / a.pf")} AS s FROM act a JOIN act b ON a.track = b.track AND a.win = b.win AND a.osc < b.osc),
con AS (SELECT track, win, sum(w * s) / sum(w) AS consonance FROM p GROUP BY ALL),
pk AS (SELECT track, win, max(amp) AS top, avg(amp) AS mean, arg_max(osc, ROW(amp, -osc)) AS peak FROM wa GROUP BY ALL)
SELECT track, win, peak, {r("(top - mean) / top")} AS confidence, {r("consonance")} AS consonance, {r("median(consonance) OVER (PARTITION BY track ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")} AS smooth FROM pk JOIN con USING (track, win)""")
def centered_features(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    keys = ["track", "win"]
    amps = rollups.mean_amp(windows.in_windows(s, windows.centred_windows(s, 12, 6)), keys)
    confidence = rollups.tempo(amps, keys).select(*keys, "confidence")
    peak = rollups.peak_oscillator(amps, keys).select(*keys, F.col("osc").alias("peak"))
    both = peak.join(confidence, keys).join(rollups.consonance(amps, keys), keys)
    return rounded(windows.median_smooth(both, "consonance", TRACK, "win"))


@query(f"WITH {STATE} SELECT track, osc, frame, {r('mean')} AS mean, CAST(n AS BIGINT) AS n FROM (SELECT track, osc, frame, avg(amp) OVER w AS mean, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY track, osc ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE n >= 8")
def trailing_ring(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.trailing(views.osc_state(spark, sf), 16, 8))


@query(f"""WITH {STATE}, strided AS (SELECT track, frame, CAST(count(*) FILTER (amp > 0.2e0) AS BIGINT) AS locks FROM st WHERE frame % 10 = 4 GROUP BY ALL)
SELECT f.track, f.frame, last_value(s.locks IGNORE NULLS) OVER (PARTITION BY f.track ORDER BY f.frame) AS locks FROM frames f LEFT JOIN strided s USING (track, frame)""")
def lock_ffill(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    strided = s.where("frame % 10 = 4").groupBy("track", "frame").agg(F.count_if(F.col("amp") > 0.2).alias("locks"))
    return windows.forward_fill(s.where("osc = 0").select("track", "frame"), strided, "locks").select("track", "frame", "locks")


@query(f"""WITH {STATE}, snaps AS (SELECT track, CAST(frame AS DOUBLE) AS t, sum(amp) AS value FROM st WHERE frame % 7 = 3 GROUP BY ALL), ends AS (SELECT track, max(t) AS last FROM snaps GROUP BY track)
SELECT f.track, {r("f.frame + 0.5e0")} AS t, {r("s.t")} AS at, {r("s.value")} AS value FROM frames f JOIN ends e USING (track)
JOIN snaps s ON s.track = f.track AND s.t = coalesce((SELECT min(x.t) FROM snaps x WHERE x.track = f.track AND x.t >= f.frame + 0.5e0), e.last)""")
def asof_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    snaps = s.where("frame % 7 = 3").groupBy("track", F.col("frame").cast("double").alias("t")).agg(F.sum("amp").alias("value"))
    times = s.where("osc = 0").select("track", (F.col("frame") + 0.5).alias("t"))
    return rounded(windows.as_of_forward(times, snaps, TRACK))


@query(f"WITH {STATE}, e AS (SELECT track, frame, sum(amp) AS energy FROM st GROUP BY ALL), l AS (SELECT track, max(frame) AS last FROM e GROUP BY track) SELECT l.track, CAST(k AS BIGINT) AS k, e.frame, {r('e.energy')} AS energy FROM l, range(0, CAST(ceil(last / 1.85e0) AS BIGINT) + 3) t(k) JOIN e ON e.track = l.track AND e.frame = greatest(0, least(CAST(round_even(k * 0.37e0 * 5e0, 0) AS BIGINT), l.last))")
def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    asks = e.groupBy("track").agg(F.max("frame").alias("last")).select("track", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("last") / 1.85).cast("long") + 2)).alias("k"))
    frame = windows.nearest_frame(F.col("k") * 0.37, 5.0, F.col("last"))
    return rounded(asks.select("track", "k", frame.alias("frame")).join(e, ["track", "frame"]).select("track", "k", "frame", "energy"))


# --- voices over time ------------------------------------------------------------------------

NEAR = "abs(12 * log2(v.freq / t.freq)) * 100 < 250"


@query(f"""WITH {VOICE_FRAMES}, {TRIGGERS}, m AS (SELECT t.trigger, v.voice, row_number() OVER (PARTITION BY t.trigger ORDER BY v.amp DESC, v.voice, v.frame) AS place FROM trg t JOIN vf v ON v.track = t.track AND v.frame BETWEEN t.first AND t.last AND {NEAR})
SELECT t.trigger, m.voice IS NOT NULL AS covered, m.voice FROM trg t LEFT JOIN m ON m.trigger = t.trigger AND m.place = 1""")
def trigger_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return voices.coverage(views.voice_frames(spark, sf), views.triggers(spark, sf), 250.0)


@query(f"WITH {VOICE_FRAMES}, {TRIGGERS} SELECT v.track, v.frame, v.voice, {r('v.freq')} AS freq, {r('v.amp')} AS amp FROM vf v WHERE NOT EXISTS (SELECT 1 FROM trg t WHERE v.track = t.track AND v.frame BETWEEN t.first AND t.last AND {NEAR})")
def phantom_voices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voices.phantom_voices(views.voice_frames(spark, sf), views.triggers(spark, sf), 250.0))


def _active_voices(spark: SparkSession, sf: str) -> DataFrame:
    return views.voice_frames(spark, sf).withColumnRenamed("freq", "centre").withColumn("active", F.lit(True))


@query(f"""WITH {VOICE_FRAMES} SELECT track, voice, min(frame) AS first, max(frame) AS last, CAST(count(*) AS BIGINT) AS frames, {r("min(freq)")} AS low, {r("max(freq)")} AS high,
{r("median(freq)")} AS middle, {r("abs(log2(arg_max(freq, frame) / arg_min(freq, frame)))")} AS drift FROM vf GROUP BY track, voice""")
def lifecycle_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voices.lifecycle(_active_voices(spark, sf)))


@query(f"""WITH {VOICE_FRAMES}, n AS (SELECT track, frame, count(*) AS n, arg_min(voice, ROW(freq, voice)) AS top FROM vf GROUP BY ALL), c AS (SELECT *, lag(top) OVER (PARTITION BY track ORDER BY frame) AS before FROM n)
SELECT track, {r("avg(n)")} AS mean, CAST(max(n) AS BIGINT) AS most, (SELECT CAST(count(DISTINCT voice) AS BIGINT) FROM vf) AS voices, CAST(count(*) FILTER (top <> before) AS BIGINT) AS changes FROM c GROUP BY track""")
def voice_churn(spark: SparkSession, sf: str) -> DataFrame:
    v = _active_voices(spark, sf)
    return rounded(voices.simultaneous(v).join(voices.top_changes(v), "track"))


@query(f"""WITH {VOICE_FRAMES}, s AS (SELECT *, lead(frame) OVER w AS nf, lead(freq) OVER w AS nfreq, lead(amp) OVER w AS namp FROM vf WINDOW w AS (PARTITION BY track, voice ORDER BY frame)),
l AS (SELECT *, (greatest(0e0, amp - 0.02e0) + greatest(0e0, namp - 0.02e0)) / 2 AS wd FROM s WHERE nf = frame + 1)
SELECT track, voice, frame, nf AS next_frame, {r("freq")} AS freq, {r("nfreq")} AS next_freq, {r("coalesce(wd / nullif(max(wd) OVER (PARTITION BY track), 0), 0e0)")} AS width FROM l""")
def voice_traces(spark: SparkSession, sf: str) -> DataFrame:
    lines = windows.trace_segments(views.voice_frames(spark, sf))
    return rounded(lines.select("track", "voice", "frame", "next_frame", "freq", "next_freq", "width"))


# --- signals and dynamics --------------------------------------------------------------------


@query(f"WITH {SIGNAL} SELECT n, {r('drive')} AS drive FROM drv")
def onset_drive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.onset_drive(views.hourly_signal(spark, sf)))


def _drive(spark: SparkSession, sf: str) -> DataFrame:
    return views.onset_drive(views.hourly_signal(spark, sf))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    """track, n, drive: a drive of its own for each channel."""
    signal = views.hourly_signal(spark, sf)
    named = signal.select("channel").distinct().withColumn("track", F.dense_rank().over(Window.orderBy("channel")).cast("long"))
    largest = signal.groupBy("channel").agg(F.max(F.abs("env")).alias("most"))
    return signal.join(F.broadcast(named), "channel").join(F.broadcast(largest), "channel").select("track", "n", (F.col("env") / F.greatest("most", F.lit(1e-9))).alias("drive"))


@query(f"WITH RECURSIVE {SIGNAL}, fold AS (SELECT n, drive AS peak FROM drv WHERE n = 0 UNION ALL SELECT d.n, CASE WHEN d.drive > f.peak THEN d.drive ELSE f.peak * 0.995e0 END FROM fold f JOIN drv d ON d.n = f.n + 1) SELECT CAST(0 AS BIGINT) AS track, n, {r('peak')} AS peak FROM fold")
def running_peak(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.running_peak(_drive(spark, sf).select(F.lit(0).cast("long").alias("track"), "n", "drive")))


@query(f"WITH {SIGNAL}, taps(lag, h) AS (VALUES (0, 0.5e0), (1, 0.3e0), (2, 0.2e0), (3, -0.1e0)) SELECT s.channel, s.n, {r('sum(t.h * x.env)')} AS y FROM sig s CROSS JOIN taps t JOIN sig x ON x.channel = s.channel AND x.n = s.n - t.lag GROUP BY ALL")
def fir_small(spark: SparkSession, sf: str) -> DataFrame:
    taps = dims.table(spark, "lag, h", [(0, 0.5), (1, 0.3), (2, 0.2), (3, -0.1)])
    return rounded(signals.fir(views.hourly_signal(spark, sf).withColumnRenamed("env", "x"), taps))


@query(f"""WITH {SIGNAL}, ch AS (SELECT channel, row_number() OVER (ORDER BY channel) AS k FROM (SELECT DISTINCT channel FROM sig)),
w AS (SELECT CAST(o AS INTEGER) AS osc, channel, g / sum(g) OVER (PARTITION BY o) AS w FROM (SELECT o, channel, exp(-pow((o - k) / 2e0, 2)) AS g FROM range(8) t(o), ch))
SELECT osc, n, {r("sum(w * env)")} AS x FROM sig JOIN w USING (channel) GROUP BY ALL""")
def project_channels(spark: SparkSession, sf: str) -> DataFrame:
    signal = views.hourly_signal(spark, sf).withColumnRenamed("env", "x")
    named = signal.select("channel").distinct().withColumn("k", F.row_number().over(Window.orderBy("channel")))
    g = named.crossJoin(spark.range(8).select(F.col("id").cast("int").alias("osc"))).withColumn("g", F.exp(-F.pow((F.col("osc") - F.col("k")) / 2.0, F.lit(2))))
    weights = g.withColumn("w", F.col("g") / F.sum("g").over(Window.partitionBy("osc"))).select("osc", "channel", "w")
    return rounded(signals.project(signal, weights))


def rk4_sql(rows: str) -> str:
    """One step of the default parameters over rows(zr, zi, om, drive, ...): adds yr, yi, mg, sc.

    Each layer names what the next one uses, so that nothing is spelled out twice.
    """
    add = lambda what, of: f"(SELECT *, {what} FROM {of})"
    at, out = ("zr", "zi"), rows
    for k, reach in enumerate((0.5, 0.5, 1.0, None), 1):
        a, b = at
        out = add(f"{a}*{a} + {b}*{b} AS m{k}", out)
        out = add(f"least(m{k}, 0.95e0) AS s{k}", out)
        out = add(f"-0.1e0 - m{k} - s{k}*s{k}/(1 - s{k}) AS g{k}", out)
        out = add(f"{a}*g{k} - {b}*om + drive AS k{k}r, {a}*om + {b}*g{k} AS k{k}i", out)
        if reach:
            out = add(f"zr + {reach * DT!r}e0*k{k}r AS a{k}r, zi + {reach * DT!r}e0*k{k}i AS a{k}i", out)
            at = (f"a{k}r", f"a{k}i")
    out = add(f"zr + (k1r + 2*k2r + 2*k3r + k4r)*{DT / 6!r}e0 AS yr, zi + (k1i + 2*k2i + 2*k3i + k4i)*{DT / 6!r}e0 AS yi", out)
    out = add("sqrt(yr*yr + yi*yi) AS mg", out)
    return add("CASE WHEN mg > 0.98e0 THEN 0.98e0 / mg ELSE 1e0 END AS sc", out)


STEPS = "(SELECT f.osc, f.om, d.n, f.zr, f.zi, f.top, d.drive FROM fold f JOIN drv d ON d.n = f.n + 1)"


@query(f"""WITH RECURSIVE {SIGNAL}, bank AS (SELECT CAST(o AS INTEGER) AS osc, 2 * pi() * 0.25e0 * pow(16e0, o / 15e0) AS om FROM range(16) t(o)),
fold AS (SELECT osc, om, CAST(-1 AS BIGINT) AS n, 1e-3 AS zr, 0e0 AS zi, 1e-3 AS top FROM bank UNION ALL
  SELECT osc, om, n, yr * sc, yi * sc, greatest(top, mg * sc) FROM {rk4_sql(STEPS)})
SELECT osc, {r("zr")} AS re, {r("zi")} AS im, {r("top")} AS top FROM fold WHERE n = (SELECT max(n) FROM drv)""")
def hopf_rk4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dynamics.drive_bank(_drive(spark, sf), dims.geometric_bank(spark, *DAY_BANK), DT, PARAMS))


LAST_FRAME = "fin AS (SELECT s.* FROM st s JOIN (SELECT track, max(frame) AS frame FROM st GROUP BY track) USING (track, frame))"


def _last_frame(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    return s.join(s.groupBy("track").agg(F.max("frame").alias("frame")), ["track", "frame"], "left_semi")


def _weights(state: DataFrame) -> DataFrame:
    a, b = state.select("track", F.col("osc").alias("i"), F.col("amp").alias("ai")), state.select("track", F.col("osc").alias("j"), F.col("amp").alias("aj"))
    return a.join(b, "track").where("i <> j").select("track", "i", "j", (F.col("ai") * F.col("aj")).alias("re"), (F.col("ai") - F.col("aj")).alias("im"))


WEIGHTS = f"{STATE}, {LAST_FRAME}, w AS (SELECT a.track, a.osc AS i, b.osc AS j, a.amp * b.amp AS re, a.amp - b.amp AS im FROM fin a JOIN fin b ON a.track = b.track AND a.osc <> b.osc)"


@query(f"""WITH {WEIGHTS} SELECT a.track, a.osc AS i, b.osc AS j, {r("coalesce(w.re, 0e0) + 0.01e0 * (0.5e0 * (a.re*b.re + a.im*b.im) - 0.1e0 * coalesce(w.re, 0e0))")} AS re,
{r("coalesce(w.im, 0e0) + 0.01e0 * (0.5e0 * (a.im*b.re - a.re*b.im) - 0.1e0 * coalesce(w.im, 0e0))")} AS im FROM fin a JOIN fin b ON a.track = b.track AND a.osc <> b.osc LEFT JOIN w ON w.track = a.track AND w.i = a.osc AND w.j = b.osc""")
def hebbian_step(spark: SparkSession, sf: str) -> DataFrame:
    z = _last_frame(spark, sf)
    return rounded(dynamics.hebbian(z, _weights(z), 0.01, 0.5, 0.1))


@query(f"WITH {WEIGHTS} SELECT w.track, w.i AS osc, {r('sum(w.re*z.re - w.im*z.im) / 32')} AS re, {r('sum(w.re*z.im + w.im*z.re) / 32')} AS im FROM w JOIN fin z ON z.track = w.track AND z.osc = w.j GROUP BY ALL")
def mean_field(spark: SparkSession, sf: str) -> DataFrame:
    z = _last_frame(spark, sf)
    return rounded(dynamics.mean_field(z.select("track", "osc", "re", "im"), _weights(z)))


@query(f"WITH {STATE}, p AS (SELECT *, row_number() OVER (PARTITION BY track, osc, floor(frame / 60e0 * 20) ORDER BY frame) AS place FROM st) SELECT track, osc, frame, {r('amp')} AS amp FROM p WHERE place = 1")
def snapshot_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf).withColumn("t", F.col("frame") / 60.0)
    return rounded(signals.snapshots(s, 20.0).select("track", "osc", "frame", "amp"))


# --- messages and exports --------------------------------------------------------------------


LAYER_FIELDS = {"amp": "amp", "phase": "phase", "phantom": "CASE WHEN amp > 0.2e0 THEN 1e0 ELSE 0e0 END", "drive": "2 * amp", "residual": "amp - 0.1e0"}


@query(f"WITH {STATE} " + " UNION ALL ".join(f"SELECT track, frame, '/pitch/{k}' AS address, {r(f'sum(CAST(CAST({v} AS FLOAT) AS DOUBLE))')} AS total, CAST(count(*) AS INTEGER) AS n FROM st GROUP BY track, frame" for k, v in LAYER_FIELDS.items()))
def osc_messages(spark: SparkSession, sf: str) -> DataFrame:
    s = views.osc_state(spark, sf)
    log = s.groupBy("track", "frame").agg(F.array_sort(F.collect_list(F.struct("osc", "amp", "phase"))).alias("__r"))
    of = lambda f: F.transform("__r", f)
    log = log.select((F.col("track") * 1_000_000 + F.col("frame")).alias("t"), F.lit("pitch").alias("layer"), of(lambda x: x["amp"]).alias("amp"), of(lambda x: x["phase"]).alias("phase"), of(lambda x: x["amp"] > 0.2).alias("phantom"), of(lambda x: 2 * x["amp"]).alias("drive"), of(lambda x: x["amp"] - 0.1).alias("residual"))
    sent = messages.layer_messages(log)
    total = F.aggregate("arr", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(sent.select(F.floor(F.col("t") / 1_000_000).alias("track"), (F.col("t") % 1_000_000).alias("frame"), "address", total.alias("total"), F.size("arr").alias("n")))


@query(f"""WITH {VOICE_FRAMES}, sp AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY track, voice ORDER BY frame) - 1, (SELECT max(frame) FROM vf)) AS last, CAST(row_number() OVER (PARTITION BY track, voice ORDER BY frame) - 1 AS DOUBLE) AS age FROM vf),
c AS (SELECT track, frame + k AS frame, voice, freq, amp, age, k AS silent FROM sp, range(0, 4) t(k) WHERE frame + k <= last), o AS (SELECT * FROM c WHERE silent = 0)
SELECT track, frame, '/voice/active_count' AS address, CAST(NULL AS VARCHAR) AS arg, CAST(count(*) FILTER (silent = 0) AS DOUBLE) AS value FROM c GROUP BY track, frame
UNION ALL SELECT track, frame, '/voice/active_ids', coalesce(string_agg(CAST(voice AS VARCHAR), '+' ORDER BY voice) FILTER (silent = 0), '-1'), NULL FROM c GROUP BY track, frame
UNION ALL SELECT track, frame, '/voice/' || voice || '/active', NULL, 1e0 FROM o UNION ALL SELECT track, frame, '/voice/' || voice || '/active', NULL, 0e0 FROM c WHERE silent = 1
UNION ALL SELECT track, frame, '/voice/' || voice || '/center_freq', NULL, {r("freq")} FROM o UNION ALL SELECT track, frame, '/voice/' || voice || '/amp', NULL, {r("amp")} FROM o
UNION ALL SELECT track, frame, '/voice/' || voice || '/phase', NULL, {r("amp / 2")} FROM o UNION ALL SELECT track, frame, '/voice/' || voice || '/confidence', NULL, {r("amp / 3")} FROM o
UNION ALL SELECT track, frame, '/voice/' || voice || '/age_frames', NULL, age FROM o""")
def voice_osc_messages(spark: SparkSession, sf: str) -> DataFrame:
    """All messages of active voices, and one at the end of a voice that falls silent."""
    frames = views.voice_frames(spark, sf)
    aged = frames.withColumn("age", F.row_number().over(Window.partitionBy("track", "voice").orderBy("frame")) - 1)
    held = reports.carried(frames, 3).join(aged, ["track", "frame", "voice"], "left")
    v = held.withColumns({"active": F.col("silent") == 0, "centre": F.col("freq"), "phase": F.col("amp") / 2, "confidence": F.col("amp") / 3})
    sent = messages.voice_messages(v)
    listed = F.col("address").endswith("_ids")
    return rounded(sent.select("track", "frame", "address", F.when(listed, F.col("arg")).alias("arg"), F.when(~listed, F.col("arg").cast("double")).alias("value")))


@query(f"""WITH {CHROMA}, {values("tpl", "seq, tonic, mode, pc, weight", KEY_ROWS)}, sc AS (SELECT track, seq, tonic, mode, {corr_sql("energy", "weight")} AS score FROM chroma JOIN tpl USING (pc) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, seq) AS place FROM sc)
SELECT track, '/features/key' AS address, tonic AS arg FROM b WHERE place = 1 UNION ALL SELECT track, '/features/mode', mode FROM b WHERE place = 1""")
def unpivot_features(spark: SparkSession, sf: str) -> DataFrame:
    key = rollups.detect_key(spark, rollups.chroma(_amps(spark, sf), TRACK), TRACK).withColumn("chord", F.lit(None).cast("string"))
    return messages.feature_messages(key, TRACK, {"tonic": "key", "mode": "mode", "chord": "chord"})


@query(f"""WITH {CHROMA}, {values("kt", "seq, tonic, mode, pc, weight", KEY_ROWS)}, {values("ct", "seq, root, quality, name, pc, weight", CHORD_ROWS)},
ks AS (SELECT track, seq, tonic, mode, {corr_sql("energy", "weight")} AS score FROM chroma JOIN kt USING (pc) GROUP BY ALL), kb AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, seq) AS place FROM ks),
cs AS (SELECT track, seq, name, {corr_sql("energy", "weight")} AS score FROM chroma JOIN ct USING (pc) GROUP BY ALL), cb AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, seq) AS place FROM cs),
ids AS (SELECT track, string_agg(CAST(osc AS VARCHAR), '+' ORDER BY osc) FILTER (amp > 0.17e0) AS v FROM amps GROUP BY track)
SELECT k.track, '0.50' AS t, k.tonic, k.mode, c.name AS chord, '?' AS bpm, coalesce(v, '-') AS voices FROM kb k JOIN cb c USING (track) JOIN ids USING (track) WHERE k.place = 1 AND c.place = 1""")
def feature_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    amps = _amps(spark, sf)
    c = rollups.chroma(amps, TRACK)
    key = rollups.detect_key(spark, c, TRACK).select("track", "tonic", "mode")
    chord = rollups.detect_chord(spark, c, TRACK).select("track", F.col("name").alias("chord"))
    ids = amps.groupBy("track").agg(F.array_sort(F.collect_list(F.when(F.col("amp") > 0.17, F.col("osc")))).alias("voice_ids"))
    rows = key.join(chord, "track").join(ids, "track").withColumns({"t": F.lit(0.5), "bpm": F.lit(None).cast("double")})
    return messages.feature_rows(rows)


@query(f"WITH {MESSAGES} SELECT CAST(split_part(address, '/', 3) AS BIGINT) AS voice, 'amp' AS field, {r('arg_max(value, seq)')} AS value FROM msg WHERE address LIKE '/voice/%/amp' GROUP BY ALL")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    fields = messages.parsed_voice_fields(views.messages(spark, sf), ["amp"])
    last = messages.latest(fields, ["voice", "field"], "arg")
    return rounded(last.select("voice", "field", F.col("arg").cast("double").alias("value")))


@query(f"""WITH {MESSAGES}, saw AS (SELECT seq, 5 * ((value + pi()) / (2 * pi()) - floor((value + pi()) / (2 * pi()))) AS v FROM msg WHERE address LIKE '/voice/%/rhythm/phase')
SELECT 0 AS channel, {r("arg_max(v, seq)")} AS volts FROM saw UNION ALL SELECT 1, {r("arg_max(greatest(0e0, least(5e0, 5 * value)), seq)")} FROM msg WHERE address = '/voice/3/amp'
UNION ALL SELECT 2, {r("arg_max(value, seq)")} FROM msg WHERE address = '/features/click' HAVING count(*) > 0""")
def held_voltages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(messages.held_voltages(messages.route(views.messages(spark, sf), _rules(spark))))


@query(f"WITH {TRIGGERS}, s AS (SELECT unnest(range(0, (SELECT max(last) + 1 FROM trg))) AS n), h AS (SELECT n, arg_max(ROW(freq, velocity), trigger) AS g FROM s JOIN trg t ON s.n BETWEEN t.first AND t.last GROUP BY n) SELECT CAST(s.n AS BIGINT) AS n, {r('coalesce(0.5e0 * h.g[2], 0e0)')} AS gate, {r('coalesce(log2(h.g[1] / 16.3516e0) / 10, 0e0)')} AS pitch FROM s LEFT JOIN h ON h.n = s.n")
def gate_voltages(spark: SparkSession, sf: str) -> DataFrame:
    t = views.triggers(spark, sf).withColumnRenamed("trigger", "seq")
    samples = t.agg(F.max("last").alias("end")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("end").cast("long"))).alias("n"))
    return rounded(messages.gate_voltages(samples, t))


@query("WITH f AS (SELECT event_type AS host, user_id % 7 AS port, min(event_id) AS first FROM events GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS place, host, port FROM f")
def endpoint_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("host"), (F.col("user_id") % 7).alias("port"))
    return messages.distinct_endpoints(e)


# --- windows of event time -------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value").where("ts IS NOT NULL")


def seconds(c: str) -> Column:
    return F.unix_timestamp(c).cast("long")


@query(f"SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start, event_type, CAST(count(*) AS BIGINT) AS n, {r('sum(value)')} AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(live.tumbling(_events(spark, sf), ["event_type"], "1 day").withColumn("start", seconds("start")))


@query(f"SELECT (CAST(floor(epoch(ts) / 7200) AS BIGINT) - k) * 7200 AS start, event_type, CAST(count(*) AS BIGINT) AS n, {r('avg(value)')} AS mean FROM events, range(3) t(k) WHERE ts IS NOT NULL GROUP BY ALL")
def sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(live.sliding(_events(spark, sf), ["event_type"], "6 hours", "2 hours").withColumn("start", seconds("start")))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 2 HOUR)) AS BIGINT) AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return live.sessions(_events(spark, sf), ["user_id"], "2 hours").withColumns({"start": seconds("start"), "end": seconds("end")})


# --- reports ---------------------------------------------------------------------------------

ENERGY = f"{STATE}, en AS (SELECT track, frame, sum(amp) AS energy FROM st GROUP BY ALL), tr AS (SELECT track, frame, avg(energy) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS energy FROM en), df AS (SELECT track, frame, abs(a.energy - b.energy) AS d FROM en a JOIN tr b USING (track, frame))"


def _two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The energy of each frame, and its trailing mean as a live path would know it."""
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    over = Window.partitionBy("track").orderBy("frame").rowsBetween(-11, 0)
    return e, e.select("track", "frame", F.avg("energy").over(over).alias("energy"))


@query(f"WITH {ENERGY} SELECT track, CAST(count(*) AS BIGINT) AS n, {r('avg(d)')} AS mean, {r('max(d)')} AS most, {r('median(d)')} AS middle, {r('avg(CASE WHEN d <= 0.1e0 THEN 1e0 ELSE 0e0 END)')} AS equal FROM df GROUP BY track")
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.agreement(*_two_runs(spark, sf), ["track", "frame"], "energy", TRACK, 0.1))


@query(f"WITH {ENERGY} SELECT * FROM (SELECT track, frame, CAST(row_number() OVER (PARTITION BY track ORDER BY d DESC, frame) AS INTEGER) AS place, {r('d')} AS diff FROM df) WHERE place <= 5")
def top_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.disagreements(*_two_runs(spark, sf), ["track", "frame"], "energy", TRACK).select("track", "frame", "place", "diff"))


@query(f"""WITH {STATE}, log AS (SELECT track, frame, 'pitch' AS layer, sum(amp) AS energy FROM st GROUP BY ALL UNION ALL SELECT track, frame - 3, 'rhythm', sum(amp) / 2 FROM st GROUP BY ALL),
ends AS (SELECT track, min(e) AS e FROM (SELECT track, layer, max(frame) AS e FROM log GROUP BY track, layer) GROUP BY track)
SELECT l.track, l.layer, l.frame, {r("l.energy")} AS energy FROM log l JOIN ends USING (track) WHERE l.frame <= e""")
def aligned_layers(spark: SparkSession, sf: str) -> DataFrame:
    e = views.osc_state(spark, sf).groupBy("track", "frame").agg(F.sum("amp").alias("energy"))
    other = e.select("track", (F.col("frame") - 3).alias("frame"), F.lit("rhythm").alias("layer"), (F.col("energy") / 2).alias("energy"))
    log = e.select("track", "frame", F.lit("pitch").alias("layer"), "energy").unionByName(other)
    return rounded(reports.aligned(log).select("track", "layer", "frame", "energy"))


@query(f"WITH {AMPS}, top AS (SELECT track, max(amp) AS top FROM amps GROUP BY track) SELECT a.track, CAST(count(*) FILTER (pf < 200e0) AS BIGINT) AS low, CAST(count(*) FILTER (pf >= 200e0 AND pf < 400e0) AS BIGINT) AS mid, CAST(count(*) FILTER (pf >= 400e0) AS BIGINT) AS high FROM amps a JOIN top USING (track) WHERE amp > greatest(0.05e0, 0.1e0 * top) GROUP BY a.track")
def band_counts(spark: SparkSession, sf: str) -> DataFrame:
    active = pairs.active_oscillators(views.osc_state(spark, sf), TRACK, 0.05, 0.1)
    return reports.band_counts(active.select("track", dims.pitch_frequency(F.col("osc")).alias("f")), 200.0, 400.0, TRACK)


@query(f"WITH {WEIGHTS}, m AS (SELECT track, i, j, sqrt(re * re + im * im) AS magnitude FROM w), q AS (SELECT track, quantile_cont(magnitude, 0.98) AS top FROM m GROUP BY track) SELECT m.track, i, j, {r('magnitude')} AS magnitude, {r('least(1e0, coalesce(magnitude / nullif(top, 0), 0e0))')} AS level FROM m JOIN q USING (track)")
def weight_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.scaled_weights(_weights(_last_frame(spark, sf))))


REPLAY_AT = [0, 100, 333, 10**9]


@query(f"""WITH {VOICE_FRAMES}, asked(wanted) AS (VALUES {", ".join(f"({t})" for t in REPLAY_AT)}), f AS (SELECT v.track, a.wanted, min(v.frame) AS frame FROM vf v JOIN asked a ON v.frame >= a.wanted GROUP BY ALL),
{values("labels", "ratio, label", dims.HARMONIC_LABELS)},
lab AS (SELECT freq, arg_min(label, abs(log2(freq / (110e0 * ratio)))) AS label, min(abs(1200 * log2(freq / (110e0 * ratio)))) AS off FROM (SELECT DISTINCT freq FROM vf), labels GROUP BY freq)
SELECT f.track, CAST(f.wanted AS BIGINT) AS wanted, f.frame, CAST(row_number() OVER (PARTITION BY f.track, f.wanted ORDER BY v.freq, v.voice) AS INTEGER) AS place, v.voice, {r("v.freq")} AS freq, {r("1200 * log2(v.freq / 110e0)")} AS cents,
CASE WHEN off < 100 THEN label ELSE '?' END AS label FROM f JOIN vf v ON v.track = f.track AND v.frame = f.frame JOIN lab USING (freq)""")
def voice_replay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.replay(views.voice_frames(spark, sf), REPLAY_AT, 110.0))


@query(f"WITH {VOICE_FRAMES} SELECT track, frame, voice, min(frame) OVER w AS first, CAST(row_number() OVER w - 1 AS INTEGER) AS age, coalesce(frame - lag(frame) OVER w - 1, 0) AS gap FROM vf WINDOW w AS (PARTITION BY track, voice ORDER BY frame)")
def voice_ages(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ages(views.voice_frames(spark, sf)).select("track", "frame", "voice", "first", "age", "gap")


@query(f"""WITH {VOICE_FRAMES}, sp AS (SELECT track, voice, frame, coalesce(lead(frame) OVER (PARTITION BY track, voice ORDER BY frame) - 1, (SELECT max(frame) FROM vf)) AS last FROM vf)
SELECT track, frame + k AS frame, voice, k AS silent FROM sp, range(0, 41) t(k) WHERE frame + k <= last""")
def carried_voices(spark: SparkSession, sf: str) -> DataFrame:
    return reports.carried(views.voice_frames(spark, sf), 40)


@query(f"WITH {VOICE_FRAMES}, h AS (SELECT track, voice, frame, list(amp) OVER (PARTITION BY track, voice ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h FROM vf) SELECT track, voice, frame, CAST(k AS INTEGER) AS place, {r('h[k + 1]')} AS amp FROM h, range(4) t(k) WHERE k < len(h)")
def voice_history(spark: SparkSession, sf: str) -> DataFrame:
    kept = reports.history(views.voice_frames(spark, sf), "amp", 4)
    return rounded(kept.select("track", "voice", "frame", F.posexplode("history").alias("place", "amp")))


@query(f"""WITH RECURSIVE {VOICE_FRAMES}, u AS (SELECT track, frame, voice, row_number() OVER (PARTITION BY track ORDER BY frame, voice) AS k FROM vf),
fold AS (SELECT track, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS slot, list_transform(range(8), lambda i: CAST(-1 AS BIGINT)) AS s, list_transform(range(8), lambda i: CAST(0 AS BIGINT)) AS l FROM (SELECT DISTINCT track FROM vf)
  UNION ALL SELECT track, k, CAST(pos - 1 AS BIGINT), list_transform(range(1, 9), lambda i: CASE WHEN i = coalesce(pos, 0) THEN voice ELSE freed[i] END), list_transform(range(1, 9), lambda i: CASE WHEN i = coalesce(pos, 0) THEN frame ELSE l[i] END)
  FROM (SELECT *, coalesce(nullif(list_position(freed, voice), 0), nullif(list_position(freed, -1), 0)) AS pos
    FROM (SELECT p.track, u.k, u.voice, u.frame, p.l, list_transform(range(1, 9), lambda i: CASE WHEN p.s[i] >= 0 AND p.l[i] < u.frame - 6 THEN -1 ELSE p.s[i] END) AS freed FROM fold p JOIN u ON u.track = p.track AND u.k = p.k + 1))),
g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track, voice ORDER BY frame) > 6 THEN 1 ELSE 0 END AS new FROM vf),
h AS (SELECT *, sum(new) OVER (PARTITION BY track, voice ORDER BY frame) AS life FROM g),
n AS (SELECT h.*, f.slot, row_number() OVER (PARTITION BY h.track, h.voice ORDER BY h.frame DESC) AS back, max(life) OVER (PARTITION BY h.track, h.voice) AS now FROM h JOIN u ON u.track = h.track AND u.voice = h.voice AND u.frame = h.frame JOIN fold f ON f.track = u.track AND f.k = u.k)
SELECT track, voice, CAST(arg_max(slot, frame) AS INTEGER) AS slot, max(frame) AS frame, {r("arg_max(freq, frame)")} AS freq, {r("arg_max(amp, frame)")} AS amp, CAST(count(*) AS INTEGER) AS depth, {r("arg_min(amp, frame)")} AS oldest
FROM n WHERE back <= 16 AND life = now GROUP BY track, voice HAVING max(frame) >= (SELECT max(frame) FROM vf) - 6 AND max(slot) FILTER (back = 1) IS NOT NULL""")
def slotted_traces(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.slotted_traces(views.voice_frames(spark, sf), 8, 16, 6)
    return rounded(found.select("track", "voice", "slot", "frame", "freq", "amp", F.size("history").alias("depth"), F.get("history", F.lit(0)).alias("oldest")))


@query(f"WITH {VOICE_FRAMES} SELECT track, frame, arg_max(voice, ROW(amp, -voice)) AS voice, {r('max(amp)')} AS amp FROM vf GROUP BY track, frame")
def dominant_voice(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.dominant(views.voice_frames(spark, sf)))


@query(f"WITH {VOICE_FRAMES}, few AS (SELECT voice FROM vf GROUP BY voice ORDER BY voice LIMIT 8) SELECT track, voice, CAST(count(*) AS BIGINT) AS frames, {r('min(freq)')} AS low, {r('max(freq)')} AS high, {r('median(freq)')} AS middle FROM vf WHERE voice IN (SELECT voice FROM few) GROUP BY track, voice")
def voice_listing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.listing(views.voice_frames(spark, sf)))


@query(f"WITH {STATE}, e AS (SELECT track, frame, sum(amp) AS energy FROM st GROUP BY ALL), sp AS (SELECT track, f AS frame FROM (SELECT DISTINCT track FROM e), range(-4, 17) t(f)) SELECT track, frame, {r('coalesce(energy, 0e0)')} AS energy FROM sp LEFT JOIN e USING (track, frame)")
def padded_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.padded(_two_runs(spark, sf)[0], F.lit(6).cast("long"), 10, TRACK, "energy"))


@query(f"WITH {STATE} SELECT track, osc, CAST(count(*) FILTER (abs(phase) < pi() / 4) AS BIGINT) AS beats FROM st GROUP BY track, osc")
def beat_pulses(spark: SparkSession, sf: str) -> DataFrame:
    return views.osc_state(spark, sf).groupBy("track", "osc").agg(F.count_if(music.beat_pulse(F.col("phase"))).alias("beats"))


@query(f"WITH {SIGNAL}, k AS (SELECT k FROM range(0, (SELECT CAST(floor((max(n) + 1) / 2.5e0) AS BIGINT) FROM drv)) t(k)) SELECT k, {r('drive')} AS drive FROM k JOIN drv ON n = least(CAST(floor(k * 2.5e0) AS BIGINT), (SELECT max(n) FROM drv))")
def decimated_drive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.decimate(_drive(spark, sf), 1.0, 2.5))


@query(f"WITH {SIGNAL}, t AS (SELECT n, sum(env) AS x FROM sig GROUP BY n) SELECT n, {r('CASE WHEN (SELECT max(abs(x)) FROM t) > 0 THEN x / (SELECT max(abs(x)) FROM t) * 0.8e0 ELSE x END')} AS x FROM t")
def peak_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synth.peak_normalized(views.hourly_signal(spark, sf).groupBy("n").agg(F.sum("env").alias("x"))))


@query(f"""WITH {TRIGGERS}, s AS (SELECT trigger, k / 20e0 AS t, (last - first + 1) / 20e0 AS d FROM trg, range(0, 21, 4) x(k))
SELECT trigger, {r("t")} AS t, {r("CASE WHEN t >= d + 0.1e0 THEN 0e0 WHEN t >= d THEN 0.7e0 * (1 - (t - d) / 0.1e0) WHEN t < 0.01e0 THEN t / 0.01e0 WHEN t < 0.06e0 THEN 1 - 0.3e0 * (t - 0.01e0) / 0.05e0 ELSE 0.7e0 END")} AS level FROM s""")
def note_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    ticks = F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(4)))
    s = views.triggers(spark, sf).select("trigger", ((F.col("last") - F.col("first") + 1) / 20.0).alias("d"), ticks.alias("k"))
    t = F.col("k") / 20.0
    return rounded(s.select("trigger", t.alias("t"), synth.adsr(t, F.col("d")).alias("level")))


# --- order-sensitive: no SQL -----------------------------------------------------------------

BANK = [0.25 * 16 ** (k / 15) for k in range(16)]


@query()
def grfnn_bank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dynamics.simulate(_tracks(spark, sf), BANK, BankConfig(learn_rate=0.5, weight_decay=0.1), 24))


@query()
def motor_coupled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dynamics.simulate_coupled(_tracks(spark, sf), BANK, BankConfig(), 0.4, 0.2, 24))


@query()
def delay_noise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dynamics.simulate(_tracks(spark, sf), BANK, BankConfig(delay=0.5, delay_gain=0.1, noise=0.01, noise_seed=3), 24))


@query()
def gammatone_envelope(spark: SparkSession, sf: str) -> DataFrame:
    signal = _tracks(spark, sf).withColumnRenamed("drive", "x")
    return signals.filterbank(signal, [2.0, 4.0, 8.0], 24.0)


@query()
def voice_tracking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voices.track_voices(views.osc_state(spark, sf), 25, 1, CLUSTERING))


@query()
def voice_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voices.lifecycle(voices.track_voices(views.osc_state(spark, sf), 25, 4, CLUSTERING)))


@query()
def mode_locks_bulk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.mode_locks_gram(views.osc_state(spark, sf), 0.3))


from resonant import catalog_extra  # noqa: E402, F401  registers its queries
