"""Messages, routing and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonant.functions.common import to_every_task
from resonant.functions.routing import address_matches, control_value, output_channel, output_kind, scaled


def layer_messages(log: DataFrame) -> DataFrame:
    """address, t, arr: five messages a snapshot of log(t, layer, amp, phase, phantom, drive, residual)."""
    parts = {"amp": "amp", "phase": "phase", "phantom": F.transform("phantom", lambda p: p.cast("float")), "drive": "drive", "residual": "residual"}
    rows = F.array(*[F.struct(F.lit(k).alias("field"), (F.col(v) if isinstance(v, str) else v).cast("array<float>").alias("arr")) for k, v in parts.items()])
    return log.select("t", "layer", F.explode(rows).alias("m")).select("t", F.concat(F.lit("/"), F.col("layer"), F.lit("/"), F.col("m.field")).alias("address"), F.col("m.arr").alias("arr"))


def feature_messages(features: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """keys, address, arg: one message for each named column that has a value."""
    rows = F.array(*[F.struct(F.lit(f"/features/{address}").alias("address"), F.col(c).cast("string").alias("arg")) for c, address in names.items()])
    return features.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.address", "m.arg").where("arg IS NOT NULL")


def rhythm_messages(peaks: DataFrame, companions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, address, arg: four messages of the peak(osc, f, bpm, phase), the number of companions, four of each companion in order."""
    pair = lambda k, v: F.struct(F.lit(k).alias("address"), v.cast("string").alias("arg"))
    head = F.array(pair("/rhythm/peak/freq", F.col("f")), pair("/rhythm/peak/bpm", F.col("bpm")), pair("/rhythm/peak/phase", F.col("phase")), pair("/rhythm/peak/idx", F.col("osc")))
    listed = F.array_sort(F.collect_list(F.struct("seq", "p", "q", "f", "phase", "plv")))
    found = peaks.select(*keys).join(companions.groupBy(*keys).agg(listed.alias("found")), keys, "left")
    count = found.select(*keys, F.lit("/rhythm/companion/count").alias("address"), F.coalesce(F.array_size("found"), F.lit(0)).cast("string").alias("arg"))
    each = found.select(*keys, F.posexplode("found").alias("place", "c"))
    base = F.concat(F.lit("/rhythm/companion/"), F.col("place").cast("string"))
    field = lambda k, v: F.struct(F.concat(base, F.lit(f"/{k}")).alias("address"), v.cast("string").alias("arg"))
    fields = F.array(field("ratio", F.concat_ws("/", "c.p", "c.q")), field("freq", F.col("c.f")), field("phase", F.col("c.phase")), field("plv", F.col("c.plv")))
    flat = lambda df, rows: df.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.address", "m.arg")
    return flat(peaks, head).unionByName(count).unionByName(flat(each, fields))


def voice_messages(voices: DataFrame) -> DataFrame:
    """track, frame, address, arg: counts and ids of a frame, fields of its active voices, and each voice's end once.

    A voice with a struct rhythm or motor (osc, freq, bpm, phase, confidence) that is
    not null has five messages for it.
    """
    frame = ["track", "frame"]
    head = voices.groupBy(*frame).agg(F.count_if("active").alias("n"), F.array_sort(F.collect_list(F.when(F.col("active"), F.col("voice")))).alias("ids"))
    listed = F.when(F.size("ids") > 0, F.array_join(F.transform("ids", lambda i: i.cast("string")), "+")).otherwise("-1")
    counts = head.select(*frame, F.explode(F.array(F.struct(F.lit("/voice/active_count").alias("address"), F.col("n").cast("string").alias("arg")), F.struct(F.lit("/voice/active_ids").alias("address"), listed.alias("arg")))).alias("m"))
    base = F.concat(F.lit("/voice/"), F.col("voice").cast("string"), F.lit("/"))
    fields = {"active": F.lit("1"), "center_freq": F.col("centre").cast("string"), "amp": F.col("amp").cast("string"), "phase": F.col("phase").cast("string"), "confidence": F.col("confidence").cast("string"), "age_frames": F.col("age").cast("string")}
    for bank in ("rhythm", "motor"):
        if bank in voices.columns:
            fields |= {f"{bank}/{k}": F.col(f"{bank}.{c}").cast("string") for k, c in (("freq", "freq"), ("bpm", "bpm"), ("phase", "phase"), ("osc_idx", "osc"), ("confidence", "confidence"))}
    rows = F.filter(F.array(*[F.struct(F.concat(base, F.lit(k)).alias("address"), v.alias("arg")) for k, v in fields.items()]), lambda m: m["arg"].isNotNull())
    on = voices.where("active").select(*frame, F.explode(rows).alias("m"))
    off = voices.where("NOT active AND silent = 1").select(*frame, F.struct(F.concat(base, F.lit("active")).alias("address"), F.lit("0").alias("arg")).alias("m"))
    return counts.unionByName(on).unionByName(off).select(*frame, "m.address", "m.arg")


def route(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """seq, address, kind, channel, value of messages(seq, address, arg) that a rule takes.

    A short table of rules goes to every task, and messages do not move.
    """
    met = messages.join(to_every_task(rules.select("source", "output", "scale")), address_matches(F.col("source"), F.col("address")))
    out = met.select("seq", "address", output_kind(F.col("output")).alias("kind"), output_channel(F.col("output")).alias("channel"), F.col("output"), scaled(F.col("scale"), F.col("arg")).alias("value"))
    return out.where("value IS NOT NULL AND (channel IS NOT NULL OR output = 'midi/clock')").drop("output")


def held_voltages(routed: DataFrame, channels: int = 8) -> DataFrame:
    """channel, volts: the last value of each control-voltage channel; others are dropped."""
    inside = routed.where((F.col("kind") == "cv") & F.col("channel").between(0, channels - 1))
    return inside.groupBy("channel").agg(F.max_by("value", "seq").alias("volts"))


def control_changes(routed: DataFrame) -> DataFrame:
    return routed.where("kind = 'midi' AND channel IS NOT NULL").select("seq", "channel", control_value(F.col("value")).alias("value"))


def clock_messages(tempos: DataFrame, keys: list[str], per_beat: int = 24) -> DataFrame:
    """keys, tick, at: the clock's ticks in each window of tempos(keys, start, end, bpm), in seconds; none without a tempo."""
    gap = F.lit(60.0) / (F.col("bpm") * per_beat)
    some = tempos.where("bpm > 0 AND end > start")
    ticks = some.select(*keys, "start", gap.alias("__gap"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("end") - F.col("start")) / gap) - 1)).alias("tick"))
    return ticks.select(*keys, "tick", (F.col("start") + F.col("tick") * F.col("__gap")).alias("at"))


def chord_notes(chords: DataFrame, keys: list[str], channel: int = 0, base: int = 60, velocity: int = 96) -> DataFrame:
    """keys, seq, type, channel, note, velocity where the notes change from one row of chords(keys, seq, notes) to the next.

    notes are pitch classes. Notes that end come before notes that begin; the last ones end with nothing after them.
    """
    over = Window.partitionBy(*keys).orderBy("seq")
    none = F.array().cast("array<int>")
    now, before = F.coalesce("notes", none), F.coalesce(F.lag("notes").over(over), none)
    event = lambda kind, v: lambda n: F.struct(F.lit(kind).alias("type"), (n + base).cast("int").alias("note"), F.lit(v).alias("velocity"))
    changes = F.concat(F.transform(F.array_sort(F.array_except(before, now)), event("note_off", 0)), F.transform(F.array_sort(F.array_except(now, before)), event("note_on", velocity)))
    return chords.select(*keys, "seq", changes.alias("__c")).select(*keys, "seq", F.posexplode("__c").alias("place", "e")).select(*keys, "seq", "place", "e.type", F.lit(channel).alias("channel"), "e.note", "e.velocity")


def forward(messages: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Every message to every endpoint, each endpoint once; endpoints are few."""
    return messages.crossJoin(to_every_task(distinct_endpoints(endpoints)))


def distinct_endpoints(endpoints: DataFrame) -> DataFrame:
    """place, host, port: repeated ones once, in the order of their first place."""
    first = endpoints.groupBy("host", "port").agg(F.min("seq").alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("place"), "host", "port")


def parsed_voice_fields(messages: DataFrame, fields: list[str]) -> DataFrame:
    """seq, voice, field, arg of /voice/<id>/<field> messages; others, unknown fields and odd ids are dropped."""
    parts = F.split(F.regexp_replace("address", "^/+", ""), "/")
    found = messages.where(F.size(parts) == 3).select("seq", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).try_cast("long").alias("voice"), F.get(parts, F.lit(2)).alias("field"), "arg")
    return found.where((F.col("head") == "voice") & F.col("voice").isNotNull() & F.col("field").isin(fields)).drop("head")


def latest(messages: DataFrame, keys: list[str], value: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.max_by(value, "seq").alias(value))


def feature_rows(features: DataFrame) -> DataFrame:
    """The lines of a feature export: t, tonic, mode, chord, bpm, voices; lists joined by +, - if empty, ? for no tempo."""
    ids = F.when(F.size("voice_ids") > 0, F.array_join(F.transform("voice_ids", lambda i: i.cast("string")), "+")).otherwise("-")
    return features.select("track", F.format_string("%.2f", "t").alias("t"), "tonic", "mode", "chord", F.when(F.col("bpm").isNotNull(), F.format_string("%.0f", "bpm")).otherwise("?").alias("bpm"), ids.alias("voices"))


def feature_lines(features: DataFrame, voices: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the columns of a feature export as text.

    features(keys, t, tonic, mode, chord, bpm, peak_phase, peak_freq, n_companions,
    consonance), voices(keys, voice, rhythm_bpm, motor_bpm). Lists are joined by + in the
    order of the voices, - if there are none, ? for a voice without a tempo.
    """
    listed = F.array_sort(F.collect_list(F.struct("voice", "rhythm_bpm", "motor_bpm")))
    rows = features.join(voices.groupBy(*keys).agg(listed.alias("__v")), keys, "left")
    rows = rows.withColumn("__v", F.coalesce("__v", F.array().cast("array<struct<voice:long,rhythm_bpm:double,motor_bpm:double>>")))
    joined = lambda f: F.when(F.size("__v") > 0, F.array_join(F.transform("__v", f), "+")).otherwise("-")
    tempo = lambda c: lambda v: F.when(v[c] > 0, F.format_string("%.0f", v[c])).otherwise("?")
    numbers = [F.format_string(f, c).alias(c) for c, f in (("bpm", "%.3f"), ("peak_phase", "%.4f"), ("peak_freq", "%.4f"))]
    return rows.select(
        *keys, F.format_string("%.3f", "t").alias("t"), "tonic", "mode", "chord", *numbers, F.col("n_companions").cast("string").alias("n_companions"),
        F.format_string("%.4f", "consonance").alias("consonance"), F.size("__v").cast("string").alias("n_voices"), joined(lambda v: v["voice"].cast("string")).alias("voice_ids"),
        joined(tempo("rhythm_bpm")).alias("voice_rhythm_bpms"), joined(tempo("motor_bpm")).alias("voice_motor_bpms"),
    )


def gate_voltages(samples: DataFrame, triggers: DataFrame) -> DataFrame:
    """n, gate, pitch: of the last trigger that a sample lies in, 0 outside; triggers(seq, first, last, freq, velocity)."""
    spread = triggers.select("seq", "freq", "velocity", F.explode(F.sequence("first", "last")).alias("n"))
    last = spread.groupBy("n").agg(F.max_by(F.struct("freq", "velocity"), "seq").alias("g"))
    pitch = F.log2(F.col("g.freq") / 16.3516) / 10
    return samples.join(last, "n", "left").select("n", F.coalesce(0.5 * F.col("g.velocity"), F.lit(0.0)).alias("gate"), F.coalesce(pitch, F.lit(0.0)).alias("pitch"))
