"""The live path: the batch operators over micro-batches, with state kept for each track.

Event time is a TIMESTAMP column `ts`. Late rows beyond the watermark are dropped.
Windows above the watermark come out when later rows move it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from resonant.operators import rollups
from resonant.operators.messages import route
from resonant.operators.rhythm import next_peak
from resonant.operators.voices import VOICES, Tracker, Voice, voice_rows, window_voices
from resonant.plans.config import BankConfig, VoiceConfig
from resonant.operators.dynamics import Bank
from resonant.plans.dims import N_OSC
from resonant.session import ship


def read_parquet_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream over a folder's files; `files` bounds a micro-batch, which paces the load."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def tumbling(events: DataFrame, keys: list[str], length: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, keys: list[str], length: str, slide: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), *keys)
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def route_stream(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """The batch router on a stream: a join with a static, broadcast rule table."""
    return route(messages, rules)


def assemble(fields: DataFrame, late: str = "10 seconds") -> DataFrame:
    """track, frame, ts and its fields, if all five of a snapshot came; fields(track, frame, ts, field, value).

    The fields of a snapshot share its time. Snapshots wait for their fields until the
    watermark passes them, then whole ones come out and the others are forgotten.
    """
    need = ["amp", "phase", "phantom", "drive", "residual"]
    picked = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in need]
    came = sum((F.coalesce(F.max(F.when(F.col("field") == f, 1)), F.lit(0)) for f in need), F.lit(0))
    whole = fields.withWatermark("ts", late).groupBy("track", "frame", "ts").agg(*picked, came.alias("__n"))
    return whole.where(F.col("__n") == len(need)).drop("__n")


def live_bank(chunks: DataFrame, f: list[float], config: BankConfig) -> DataFrame:
    """track, n, osc, re, im after the chunks of a micro-batch of chunks(track, first, x).

    All of the bank goes on from chunk to chunk: state, weights, delay ring, noise and
    counts, so that chunks give what one run over all samples gives. Chunks of a track
    are taken in the order of their first sample within a micro-batch.
    """
    ship(chunks.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank = Bank(np.array(f), config)
        done = 0
        if state.exists:
            done, saved = state.get
            bank.restore(bytes(saved))
        rows = pd.concat(list(parts)).sort_values("first")
        for first, x in zip(rows["first"], rows["x"]):
            for value in x:
                bank.step(np.full(len(f), value))
            done = int(first) + len(x)
        state.update((done, bank.saved()))
        yield pd.DataFrame({"track": key[0], "n": done, "osc": np.arange(len(f), dtype=np.int32), "re": bank.z.real, "im": bank.z.imag})

    return chunks.groupBy("track").applyInPandasWithState(run, "track long, n long, osc int, re double, im double", "done long, bank binary", "append", GroupStateTimeout.NoTimeout)


def live_voices(frames: DataFrame, depth: int, least: int = 8, config: VoiceConfig = VoiceConfig(), idle_ms: int | None = None) -> DataFrame:
    """Voices of frames(track, frame, amp array, phase array) with a trailing window of `depth` frames for each track.

    Silent voices retire as the configuration says; a track without a frame for idle_ms is forgotten.
    """
    ship(frames.sparkSession)
    f = 110.0 * 2 ** (np.arange(N_OSC) / 12)
    columns = [c.strip().split()[0] for c in VOICES.split(",")]
    kept = "amps array<array<double>>, voices array<struct<id:long,members:array<int>,centre:double,amp:double,phase:double,confidence:double,active:boolean,age:int,silent:int>>, next_id long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker, ring = Tracker(config), []
        if state.exists:
            amps, voices, tracker.next_id = state.get
            ring = [[float(x) for x in a] for a in amps]
            tracker.voices = [Voice(v[0], frozenset(v[1]), *v[2:]) for v in voices]
        out = []
        for row in pd.concat(list(parts)).sort_values("frame").itertuples():
            ring = [*ring, np.asarray(row.amp, float).tolist()][-depth:]
            if len(ring) >= least:
                out += voice_rows(int(key[0]), int(row.frame), tracker.advance(window_voices(np.array(ring), np.array(row.phase), f, config)))
        saved = [(int(v.id), sorted(v.members), v.centre, v.amp, v.phase, v.confidence, v.active, int(v.age), int(v.silent)) for v in tracker.voices]
        state.update((ring, saved, int(tracker.next_id)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("track").applyInPandasWithState(run, VOICES, kept, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def live_peaks(frames: DataFrame, keep: float = 0.8) -> DataFrame:
    """track, frame, peak of frames(track, frame, amp array): the rhythm bank's peak, kept from batch to batch as peak_hysteresis keeps it."""
    ship(frames.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(parts)).sort_values("frame")
        peaks = []
        for amp in rows["amp"]:
            last = next_peak(np.asarray(amp, float), last, keep)
            peaks.append(last)
        state.update((int(last),))
        yield pd.DataFrame({"track": key[0], "frame": rows["frame"].to_numpy(), "peak": np.array(peaks, np.int32)})

    return frames.select("track", "frame", "amp").groupBy("track").applyInPandasWithState(run, "track long, frame long, peak int", "peak int", "append", GroupStateTimeout.NoTimeout)


def tick_features(frames: DataFrame, share: float = 0.1) -> DataFrame:
    """track, frame and the key, chord, tempo and consonance of each frame of frames(track, frame, amp array).

    The extractors are the batch ones, over windows of one frame.
    """
    spark, keys = frames.sparkSession, ["track", "frame"]
    amps = frames.select(*keys, F.posexplode("amp").alias("osc", "amp"))
    chroma = rollups.chroma(amps, keys)
    key = rollups.detect_key(spark, chroma, keys).withColumnRenamed("confidence", "key_confidence")
    chord = rollups.detect_chord(spark, chroma, keys).select(*keys, F.col("name").alias("chord"), F.col("confidence").alias("chord_confidence"))
    tempo = rollups.tempo(amps, keys).withColumnRenamed("confidence", "tempo_confidence")
    return key.join(chord, keys).join(tempo, keys).join(rollups.consonance(amps, keys, share), keys)


def each_tick(frames: DataFrame, path: str, checkpoint: str, share: float = 0.1) -> None:
    """Write tick_features of what a stream brings to a folder for each micro-batch; a batch that comes again replaces its own."""

    def snapshot(batch: DataFrame, number: int) -> None:
        tick_features(batch, share).write.mode("overwrite").parquet(f"{path}/batch={number}")

    frames.writeStream.foreachBatch(snapshot).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(frames: DataFrame, folder: str, batches: int = 4, share: float = 0.1) -> DataFrame:
    """track, frame, the features of tick_features, and peak: frames(track, frame, amp array) once more as a stream.

    The frames arrive in `batches` stretches of time, each of which the two streams take
    as a micro-batch; what they carry over lies in their checkpoints.
    """
    spark = frames.sparkSession
    last = frames.agg(F.max("frame")).first()[0]
    width = ((0 if last is None else last) + batches) // batches
    for k in range(batches):
        frames.where(F.floor(F.col("frame") / width) == k).write.mode("append").parquet(f"{folder}/frames")
        stream = spark.readStream.schema("track long, frame long, amp array<double>").parquet(f"{folder}/frames")
        each_tick(stream, f"{folder}/features", f"{folder}/features-state", share)
        peaks = live_peaks(stream).writeStream.format("parquet").option("path", f"{folder}/peaks").option("checkpointLocation", f"{folder}/peaks-state")
        peaks.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/features").drop("batch").join(spark.read.parquet(f"{folder}/peaks"), ["track", "frame"])


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table in memory: for tests and small replays."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
