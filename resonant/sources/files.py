"""Audio, state-log and rule files."""

from __future__ import annotations

import io
import math
import struct
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.plans.config import rules_from_toml
from resonant.session import ship

SIGNAL = "track string, rate int, x array<float>"


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1..1; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def decode_aiff(data: bytes) -> tuple[int, np.ndarray]:
    """As decode_wav, of AIFF and uncompressed AIFF-C: chunks of big-endian integers."""
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("no AIFF file")
    channels = width = rate = 0
    little, raw, at = False, b"", 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        part = data[at + 8 : at + 8 + size]
        if name == b"COMM":
            channels, width = int.from_bytes(part[:2], "big"), (int.from_bytes(part[6:8], "big") + 7) // 8
            rate = round(int.from_bytes(part[10:18], "big") * 2.0 ** (int.from_bytes(part[8:10], "big") - 16383 - 63))  # 80-bit float
            if part[18:22] not in (b"", b"NONE", b"twos", b"sowt"):
                raise ValueError(f"AIFF-C compression {part[18:22]!r}")
            little = part[18:22] == b"sowt"
        elif name == b"SSND":
            raw = part[8 + int.from_bytes(part[:4], "big") :]
        at += 8 + size + size % 2
    return rate, _mono(raw, f"{'<' if little else '>'}i{width}", channels)


def decode_au(data: bytes) -> tuple[int, np.ndarray]:
    """As decode_wav, of AU files with linear integers or floats."""
    head = [int.from_bytes(data[k : k + 4], "big") for k in range(4, 24, 4)]
    kinds = {2: ">i1", 3: ">i2", 4: ">i3", 5: ">i4", 6: ">f4", 7: ">f8"}
    if data[:4] != b".snd" or head[2] not in kinds:
        raise ValueError("no AU file of linear samples")
    return head[3], _mono(data[head[0] :], kinds[head[2]], head[4])


def decode_raw(data: bytes, rate: int = 16_000, kind: str = "<i2", channels: int = 1) -> tuple[int, np.ndarray]:
    """Samples without a header, by default 16-bit mono."""
    return rate, _mono(data, kind, channels)


def _mono(raw: bytes, kind: str, channels: int) -> np.ndarray:
    """The mean of the channels, integers scaled to -1..1."""
    order, width = kind[0], int(kind[2])
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if kind[1] == "f":
        x = np.frombuffer(raw, kind).astype(np.float64)
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)[:, :: -1 if order == ">" else 1]
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, kind) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def by_command(command: list[str], rate: int) -> Callable[[bytes], tuple[int, np.ndarray]]:
    """A decoder that gives a file to a program's standard input and takes 32-bit floats, mono at `rate`, from its output."""

    def decode(data: bytes) -> tuple[int, np.ndarray]:
        return rate, np.frombuffer(subprocess.run(command, input=data, capture_output=True, check=True).stdout, "<f4")

    return decode


#: By suffix; callers add decoders for other formats.
DECODERS = {"wav": decode_wav, "aiff": decode_aiff, "aif": decode_aiff, "au": decode_au, "snd": decode_au, "raw": decode_raw}


def resample(x: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Polyphase resampling with a Kaiser-windowed sinc; the length is ceil(n * wanted / rate)."""
    if rate == wanted or not len(x):
        return x
    g = math.gcd(rate, wanted)
    up, down = wanted // g, rate // g
    reach = 10 * max(up, down)
    t = np.arange(-reach, reach + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(len(t), 5.0)
    taps *= up / taps.sum()
    n_out = -(-len(x) * up // down)
    out = np.zeros(n_out)
    at = np.arange(n_out) * down + reach  # place in the up-sampled, filtered signal
    for k in range(-(-len(taps) // up)):
        source = at // up - k
        tap = at - source * up
        ok = (source >= 0) & (source < len(x)) & (tap < len(taps))
        out[ok] += x[source[ok]] * taps[tap[ok]]
    return out.astype(np.float32)


def scan_audio(spark: SparkSession, path: str, rate: int = 16_000, decoders: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] = DECODERS) -> DataFrame:
    """track, rate, x of the audio files under path whose suffixes have decoders, each decoded where it is read."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, x = decoders[name.rpartition(".")[2].lower()](data.as_py())
                yield pa.RecordBatch.from_pydict({"track": [name.rpartition("/")[2].rpartition(".")[0]], "rate": pa.array([rate], pa.int32()), "x": pa.array([resample(x, own, rate)], pa.list_(pa.float32()))})

    glob = "*.{" + ",".join(sorted({s for k in decoders for s in (k, k.upper())})) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SIGNAL)


def scan_wav(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """scan_audio of the WAV files alone."""
    return scan_audio(spark, path, rate, {"wav": decode_wav})


def samples(signal: DataFrame) -> DataFrame:
    """track, n, t, x: one row a sample."""
    flat = signal.select("track", "rate", F.posexplode("x").alias("n", "x"))
    return flat.select("track", F.col("n").cast("long").alias("n"), (F.col("n") / F.col("rate")).alias("t"), "x")


STATE_LOG = "t double, layer string, z_real array<float>, z_imag array<float>, amp array<float>, phase array<float>, drive array<float>, residual array<float>, phantom array<boolean>"


def scan_state_log(spark: SparkSession, path: str, layer: str | None = None, in_order: bool = False) -> DataFrame:
    """Snapshots; a file without residuals gets zeros. The layer filter reaches the scan, sorting by time is on request."""
    log = spark.read.schema(STATE_LOG).parquet(path)
    if layer is not None:
        log = log.where(F.col("layer") == layer)
    zeros = F.transform("amp", lambda _: F.lit(0.0).cast("float"))
    log = log.withColumn("residual", F.coalesce("residual", zeros))
    return log.orderBy("t") if in_order else log


def footer_bank(spark: SparkSession, footer: dict[bytes, bytes]) -> DataFrame:
    """layer, osc, f from a state log's footer, in which layer.<name>.f lists frequencies."""
    found = [(k.decode()[6:-2], v.decode()) for k, v in (footer or {}).items() if k.startswith(b"layer.") and k.endswith(b".f")]
    lines = spark.createDataFrame(found, "layer string, line string")
    parts = lines.where("line <> ''").select("layer", F.posexplode(F.split("line", ",")).alias("osc", "f"))
    return parts.select("layer", "osc", F.col("f").cast("double").alias("f"))


def write_state_log(log: DataFrame, path: str) -> None:
    """Partitioned by track and layer; writing a track again replaces that track only."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track", "layer").parquet(path)


def osc_packet(address: str, args: list) -> bytes:
    """One OSC message: address, type tags, and arguments that are integers, floats or strings."""
    padded = lambda b: b + b"\0" * (4 - len(b) % 4)
    kinds = {int: ("i", lambda v: struct.pack(">i", v)), float: ("f", lambda v: struct.pack(">f", v)), str: ("s", lambda v: padded(v.encode()))}
    return padded(address.encode()) + padded(("," + "".join(kinds[type(a)][0] for a in args)).encode()) + b"".join(kinds[type(a)][1](a) for a in args)


def osc_messages(packet: bytes) -> list[tuple[str, list[str]]]:
    """Address and arguments, as text, of the message in a packet, or of all messages of a bundle; none of a broken one."""

    def text(at: int) -> tuple[str, int]:
        end = packet.index(b"\0", at)
        return packet[at:end].decode(), end + 4 - (end - at) % 4

    if packet[:8] == b"#bundle\0":
        out, at = [], 16
        while at + 4 <= len(packet):
            size = int.from_bytes(packet[at : at + 4], "big")
            out += osc_messages(packet[at + 4 : at + 4 + size])
            at += 4 + size
        return out
    try:
        address, at = text(0)
        tags, at = text(at)
        args = []
        for tag in tags[1:]:
            if tag == "s":
                value, at = text(at)
            elif tag in "TF":
                value = "1" if tag == "T" else "0"
            else:
                form, size = {"i": (">i", 4), "f": (">f", 4), "h": (">q", 8), "d": (">d", 8)}[tag]
                value, at = str(struct.unpack_from(form, packet, at)[0]), at + size
            args.append(value)
    except (ValueError, KeyError, struct.error):
        return []
    return [(address, args)] if address.startswith("/") else []


def decode_packets(packets: DataFrame) -> DataFrame:
    """seq, address, arg of packets(seq, packet), a table or a stream of any source: the first argument as text, empty if there is none."""
    ship(packets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, a, args[0] if args else "") for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, args in osc_messages(p or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["seq", "address", "arg"])

    return packets.select("seq", "packet").mapInArrow(run, "seq long, address string, arg string")


WEIGHTS = "t double, i int, j int, re double, im double"


def write_weights(weights: DataFrame, path: str) -> None:
    """weights(track, layer, t, i, j, re, im): a history, partitioned by track and layer; a track written again replaces itself."""
    weights.select("track", "layer", "t", "i", "j", "re", "im").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track", "layer").parquet(path)


def scan_weights(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """track, layer, t, i, j, re, im; no rows where nothing was written. The layer filter prunes folders."""
    schema = f"track string, layer string, {WEIGHTS}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{WEIGHTS}, track string, layer string").parquet(path).select("track", "layer", "t", "i", "j", "re", "im")
    return found if layer is None else found.where(F.col("layer") == layer)


def final_weights(weights: DataFrame) -> DataFrame:
    """The last weights of each track and layer."""
    last = weights.groupBy("track", "layer").agg(F.max("t").alias("t"))
    return weights.join(last, ["track", "layer", "t"])


def rules(spark: SparkSession, text: str) -> DataFrame:
    """seq, source, output, scale of a TOML rule file."""
    return spark.createDataFrame([(k, r.source, r.output, r.scale) for k, r in enumerate(rules_from_toml(text))], "seq int, source string, output string, scale string")
