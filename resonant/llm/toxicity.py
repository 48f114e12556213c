"""Toxicity scores by a factorization machine over hashed terms.

A document's features are the distinct words of its whole text and their first
four, five and six letters, hashed; first letters that two or three different words
have count as terms of their own. The machine adds a weight for each feature and
the inner product of the factors of each pair of features, so that a pair (an
insult with the mention of a group) can weigh more than its parts.

It is fitted on a bounded sample: at most `sample` labelled rows, chosen by a hash
of doc_id, whatever the number of labels. Spark counts the sample's terms by label;
the driver gets the best terms, at most `most_features` whose rates differ by
`least_z` standard errors and `pair_terms` weaker ones, and then, for each row, which of
these it has. A weaker term stays if the rates of a pair with it differ by
`least_pair_z`: so a term that tells nothing on its own is learned where its pair
does. Terms without such support are left out, which keeps long texts from gathering
the noise of many words. Every document is scored from its whole text.

Defined cases
    null or empty text     scored as a document without features
    no usable labels       score 0 for all
    one class only         the machine learns that class's base rate
    repeated labels        a doc_id is toxic if any of its labels says so
    null doc_id            scored, held_out false, never learned from
    repeated rows          each gives its own row
    very long texts        all distinct words count, nothing of them reaches the driver
    ties                   of terms that differ alike, the smaller hash comes first;
                           a score of exactly the threshold is predicted toxic
    empty table            empty result
    extra columns          not read by `score`, kept by `clean_documents`
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.shared import bucket_of, documents, text_of, written
from resonant.session import ship


@dataclass(frozen=True)
class ToxicityConfig:
    sample: int = 16_384
    bits: int = 22
    prefixes: tuple[int, ...] = (4, 5, 6)
    repeats: int = 3  # different words with the same first letters, up to which they make a term
    least_rows: int = 4
    least_z: float = 4.0
    most_features: int = 8192
    pair_terms: int = 1024
    least_pair_z: float = 8.0
    factors: int = 8
    epochs: int = 30
    rate: float = 0.1
    decay: float = 1e-4
    batch: int = 256
    threshold: float = 0.3
    seed: int = 5
    sample_tasks: int = 24


_WORD = re.compile(r"\w+")


def word_features(word: str, config: ToxicityConfig) -> tuple[int, ...]:
    mask = (1 << config.bits) - 1
    terms = [word] + [f"{n}^{word[:n]}" for n in config.prefixes if len(word) >= n]
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) & mask for t in terms)


def repeated(term: int, times: int, config: ToxicityConfig) -> int:
    """The term for `times` words with the same term; applied twice it gives the term again."""
    return (term ^ (times - 1) * 0x2545F491) & ((1 << config.bits) - 1)


def features(text: str | None, config: ToxicityConfig) -> np.ndarray:
    words = set(_WORD.findall(text.lower())) if text else ()
    counts = Counter(h for w in words for h in word_features(w, config))
    more = {repeated(h, k, config) for h, n in counts.items() for k in range(2, min(n, config.repeats) + 1)}
    return np.array(sorted(more.union(counts)), np.int32)


@dataclass(frozen=True)
class Machine:
    """bias + sum of w over the features + sum over pairs of the factors' inner products."""

    ids: np.ndarray  # sorted hashes
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, places: np.ndarray) -> float:
        v = self.v[places]
        s = v.sum(axis=0)
        return float(self.bias + self.w[places].sum() + 0.5 * (s @ s - (v * v).sum()))


def difference(positive: np.ndarray, negative: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """By how many standard errors the rates among both labels differ."""
    p = (positive + negative) / (n1 + n0)
    return np.abs(positive / n1 - negative / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


def ranked_terms(rows: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their differences, largest first, as far as support() looks."""
    size = 1 << config.bits
    positive, negative = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for r, y in zip(rows, labels):
        (positive if y else negative)[r] += 1
    n1 = int(labels.sum())
    seen = np.flatnonzero(positive + negative >= config.least_rows)
    if not n1 or n1 == len(labels):
        return seen[:0].astype(np.int32), np.empty(0)
    z = difference(positive[seen], negative[seen], n1, len(labels) - n1)
    best = np.lexsort((seen, -z))[: config.most_features + config.pair_terms]
    return seen[best].astype(np.int32), z[best]


def support(ids: np.ndarray, z: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """The sorted hashes to learn from: of ranked terms, the strong ones and those with a strong pair."""
    strong = np.flatnonzero(z >= config.least_z)[: config.most_features]
    weak = np.setdiff1d(np.arange(len(ids)), strong)[: config.pair_terms]
    partners = np.concatenate([strong[: config.pair_terms], weak])
    if not len(weak) or not labels.any() or labels.all():
        return np.sort(ids[strong])
    column = np.full(len(ids), -1)
    column[partners] = np.arange(len(partners))
    order = np.argsort(ids)
    both = {0: np.zeros((len(weak), len(partners))), 1: np.zeros((len(weak), len(partners)))}
    for y in (0, 1):
        own = [rows[k] for k in np.flatnonzero(labels == y)]
        for lo in range(0, len(own), 1024):
            x = np.zeros((min(1024, len(own) - lo), len(partners)), np.float32)
            for k, r in enumerate(own[lo : lo + 1024]):
                at = np.searchsorted(ids[order], r)
                met = order[at[at < len(ids)]][ids[order][at[at < len(ids)]] == r[at < len(ids)]]
                x[k, column[met[column[met] >= 0]]] = 1
            both[y] += x[:, column[weak]].T @ x
    pair = difference(both[1], both[0], labels.sum(), (labels == 0).sum())
    pair[both[0] + both[1] < config.least_rows] = 0
    pair[np.arange(len(weak)), column[weak]] = 0  # a term with itself
    pair[pair <= np.maximum(z[weak][:, None], z[partners][None, :])] = 0
    telling = (pair >= config.least_pair_z).any(axis=1)
    return np.sort(ids[np.concatenate([strong, weak[telling]])])


def fit(rows: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig = ToxicityConfig(), ids: np.ndarray | None = None) -> Machine:
    """Logistic loss, Adagrad over batches in a seeded order; ids are the hashes to learn from."""
    rng = np.random.default_rng(config.seed)
    if ids is None:
        ids = support(*ranked_terms(rows, labels, config), rows, labels, config)
    places = [np.searchsorted(ids, np.intersect1d(r, ids, assume_unique=True)) for r in rows]
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), config.factors))
    gb, gw, gv = 1e-8, np.full(len(ids), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(config.epochs if len(ids) else 0):
        order = rng.permutation(len(places))
        for lo in range(0, len(order), config.batch):
            part = order[lo : lo + config.batch]
            sizes = np.array([len(places[i]) for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            at = np.concatenate([places[i] for i in part]) if sizes.sum() else np.empty(0, int)
            sums = np.zeros((len(part), config.factors))
            np.add.at(sums, row, v[at])
            squares, linear = np.zeros(len(part)), np.zeros(len(part))
            np.add.at(squares, row, (v[at] ** 2).sum(axis=1))
            np.add.at(linear, row, w[at])
            logit = bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)
            dw, dv = np.zeros(len(ids)), np.zeros(v.shape)
            np.add.at(dw, at, slope[row])
            np.add.at(dv, at, slope[row, None] * (sums[row] - v[at]))
            dw, dv = dw + config.decay * w, dv + config.decay * v
            db = slope.sum()
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias -= config.rate * db / np.sqrt(gb)
            w -= config.rate * dw / np.sqrt(gw)
            v -= config.rate * dv / np.sqrt(gv)
    return Machine(ids, bias, w, v)


def learn(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Machine | None:
    """Fit on a sample of the rows of labels(doc_id, toxic); None without usable labels."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64(F.lit(config.seed), "doc_id"), "doc_id").limit(config.sample)
    # at most `sample` rows of two numbers; of rows with the same doc_id one text, whatever their order
    train = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    train = train.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).repartition(config.sample_tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [features(t.as_py(), config).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"])

    ship(docs.sparkSession)
    rows = written(train.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, ids binary"), "toxicity-sample")
    ids, z = _ranked_in_spark(rows, config)
    if ids is None:
        return None

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(ids)
        for batch in batches:
            kept = [np.intersect1d(np.frombuffer(r.as_py(), np.int32), known, assume_unique=True).tobytes() for r in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.binary())], names=["doc_id", "toxic", "ids"])

    # at most `sample` rows, each with some of the ranked terms
    got = sorted(rows.mapInArrow(restricted, "doc_id long, toxic int, ids binary").collect())
    found, labelled = [np.frombuffer(bytes(r["ids"]), np.int32) for r in got], np.array([r["toxic"] for r in got])
    return fit(found, labelled, config, support(ids, z, found, labelled, config))


def _ranked_in_spark(rows: DataFrame, config: ToxicityConfig) -> tuple[np.ndarray | None, np.ndarray]:
    """As ranked_terms, counted by Spark; None without rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            parts = [np.frombuffer(r.as_py(), np.int32) for r in batch.column(2)]
            if parts:
                term, at = np.unique(np.concatenate(parts), return_inverse=True)
                label = np.repeat(toxic, [len(p) for p in parts])
                positive = np.bincount(at, label, len(term)).astype(np.int64)
                total = np.bincount(at, minlength=len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(positive), pa.array(total)], names=["term", "positive", "total"])

    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n:
        return None, np.empty(0)
    if n1 in (0, n):
        return np.empty(0, np.int32), np.empty(0)
    counts = rows.mapInArrow(count, "term int, positive long, total long").groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))
    p, rate = F.col("total") / n, F.col("positive") / n1 - (F.col("total") - F.col("positive")) / (n - n1)
    z = F.abs(rate) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))
    best = counts.where(F.col("total") >= config.least_rows).select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(config.most_features + config.pair_terms).collect()
    return np.array([r["term"] for r in best], np.int32), np.array([r["z"] for r in best])


class Scorer:
    """Probabilities of texts; the places of words met are kept, up to most_kept words."""

    def __init__(self, machine: Machine | None, config: ToxicityConfig, most_kept: int = 150_000):
        self.machine, self.config, self.most_kept = machine, config, most_kept
        self.place = {int(h): k for k, h in enumerate(machine.ids)} if machine else {}
        self.known: dict[str, tuple[int, ...]] = {}
        # of each term that is learned, alone or repeated: its places once, twice, ...; -1 where it is not
        levels = range(1, config.repeats + 1)
        bases = {repeated(h, k, config) for h in self.place for k in levels}
        self.levels = {h: tuple(self.place.get(repeated(h, k, config), -1) for k in levels) for h in bases}

    def score(self, text: str | None) -> float:
        if self.machine is None:
            return 0.0
        counts: dict[int, int] = {}
        known = self.known
        for w in set(_WORD.findall(text.lower())) if text else ():
            terms = known.get(w)
            if terms is None:
                if len(known) >= self.most_kept:
                    known.clear()
                terms = known[w] = tuple(h for h in word_features(w, self.config) if h in self.levels)
            for h in terms:
                counts[h] = counts.get(h, 0) + 1
        found = {p for h, n in counts.items() for p in self.levels[h][:n] if p >= 0}
        return float(1 / (1 + np.exp(-np.clip(self.machine.logit(np.array(sorted(found), int)), -30, 30))))


def score(docs: DataFrame, machine: Machine | None, config: ToxicityConfig = ToxicityConfig(), extra: dict | None = None) -> DataFrame:
    """One row per document: doc_id, the columns of extra, score, predicted. Nothing moves."""
    kept = docs.select("doc_id", *[c.alias(n) for n, c in (extra or {}).items()], "text")
    text_at = len(kept.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine, config)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(text_at)]
            predicted = pa.array([int(s >= config.threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.array(scores, pa.float64()), predicted], names=[*batch.schema.names[:text_at], "score", "predicted"])

    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:text_at])
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")


def clean_documents(docs: DataFrame, machine: Machine | None, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine, config)
        for batch in batches:
            clean = [scorer.score(t.as_py()) < config.threshold for t in batch.column(text_at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.where(bucket_of(F.col("doc_id"), "", 4) != 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), "", 4) == 2, F.lit(False))
    return score(docs, learn(docs, training_labels(spark, sf_dir)), extra={"held_out": held_out})
