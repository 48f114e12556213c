"""The state log and the signal that the queries run on, derived from the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.plans.dims import N_OSC, pitch_frequency, rhythm_frequency


def osc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, osc, re, im, amp, phase: a long state log.

    A track is a label of `embeddings`, its frames are the vectors in order, the first
    32 components are real and the last 32 imaginary parts.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("track"), "vec_id", "embedding")
    frames = numbered(vectors, "vec_id")
    parts = F.arrays_zip(F.slice("embedding", 1, N_OSC).alias("re"), F.slice("embedding", N_OSC + 1, N_OSC).alias("im"))
    flat = frames.select("track", "frame", F.posexplode(parts).alias("osc", "z"))
    re, im = F.col("z.re").cast("double"), F.col("z.im").cast("double")
    flat = flat.select("track", "frame", "osc", re.alias("re"), im.alias("im"))
    return flat.withColumns({"amp": F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "phase": F.atan2("im", "re")})


def numbered(rows: DataFrame, order: str, stretch: int = 4096) -> DataFrame:
    """Adds frame: the row's place in its track by an integer column.

    Rows are numbered in stretches of that column, and a stretch starts where the
    counts of those before it end, so that no task holds a whole track.
    """
    own = F.floor(F.col(order) / stretch)
    counts = rows.groupBy("track", own.alias("__stretch")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("track").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("track", "__stretch", F.coalesce(before, F.lit(0)).cast("long").alias("__start"))
    within = F.row_number().over(Window.partitionBy("track", "__stretch").orderBy(order)) - 1
    placed = rows.withColumn("__stretch", own).withColumn("__within", within).join(starts, ["track", "__stretch"])
    return placed.withColumn("frame", (F.col("__start") + F.col("__within")).cast("long")).drop("__stretch", "__start", "__within")


def with_bank(state: DataFrame) -> DataFrame:
    """Adds the natural frequencies, which are closed forms of osc and need no join."""
    return state.withColumns({"pitch_f": pitch_frequency(F.col("osc")), "rhythm_f": rhythm_frequency(F.col("osc"))})


def hourly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, channel, env: the value of each event type in each hour since the first, 0 where none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value").where("ts IS NOT NULL")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    sums = events.groupBy(hour.alias("hour"), F.col("event_type").alias("channel")).agg(F.sum("value").alias("env"))
    first = sums.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = first.select(F.explode(F.sequence("lo", "hi")).alias("hour"), "lo")
    channels = sums.select("channel").distinct()
    full = spine.crossJoin(channels).join(sums, ["hour", "channel"], "left")
    return full.select((F.col("hour") - F.col("lo")).alias("n"), "channel", F.coalesce("env", F.lit(0.0)).alias("env"))


def onset_drive(signal: DataFrame) -> DataFrame:
    """n, drive: rises of the summed envelope, scaled by the largest."""
    total = signal.groupBy("n").agg(F.sum("env").alias("env"))
    before = total.select((F.col("n") + 1).alias("n"), F.col("env").alias("__before"))
    rise = F.when(F.col("__before").isNotNull(), F.greatest(F.lit(0.0), F.col("env") - F.col("__before")))
    rises = total.join(before, "n", "left").select("n", F.coalesce(rise, F.lit(0.0)).alias("rise"))
    peak = rises.agg(F.max("rise").alias("peak"))
    return rises.crossJoin(F.broadcast(peak)).select("n", (F.col("rise") / (F.col("peak") + 1e-9)).alias("drive"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, address, arg: one message an event; every third is a feature, the others fields of voices."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    voice = F.concat(F.lit("/voice/"), (F.col("user_id") % 10).cast("string"), F.when(F.col("event_id") % 3 == 1, "/rhythm/phase").otherwise("/amp"))
    address = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/features/"), F.col("event_type"))).otherwise(voice)
    return events.select(F.col("event_id").alias("seq"), address.alias("address"), F.col("value").cast("string").alias("arg"))


def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, voice, freq, amp: users as voices, hours as frames."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value").where("ts IS NOT NULL")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    grouped = events.groupBy((F.col("user_id") % 50).cast("long").alias("voice"), hour.alias("hour")).agg(F.min(F.col("event_id") % 36).alias("semi"), F.avg("value").alias("amp"))
    first = F.broadcast(grouped.agg(F.min("hour").alias("first")))
    freq = 110.0 * F.pow(F.lit(2.0), F.col("semi") / 12.0)
    return grouped.crossJoin(first).select(F.lit(0).cast("long").alias("track"), (F.col("hour") - F.col("first")).alias("frame"), "voice", freq.alias("freq"), "amp")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trigger, track, first, last, freq, velocity: orders as notes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    first = F.col("o_custkey") % 600
    return orders.select(
        F.col("o_orderkey").alias("trigger"),
        F.lit(0).cast("long").alias("track"),
        first.alias("first"),
        (first + F.col("o_orderkey") % 20).alias("last"),
        (110.0 * F.pow(F.lit(2.0), (F.col("o_orderkey") % 36) / 12.0)).alias("freq"),
        ((F.col("o_custkey") % 10) / 10.0).alias("velocity"),
    )
