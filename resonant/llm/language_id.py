"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A trigram's
vector binds those of its letters, permuted by their place (rotated by two, one and
no places, then multiplied). A document bundles the vectors of its trigrams by
adding them; a language's prototype bundles the unit vectors of its documents. The
prototype with the largest cosine is the answer.

Prototypes are learned from a bounded sample: about `per_language` documents of
each of the `most_languages` lang values with most documents, chosen by a hash of
doc_id. Their number does not grow with the table, nor with what a dirty lang column
holds; every document is identified from its whole text.

Defined cases
    null text, no letters     und, score 0
    no labelled documents     und, score 0 for all
    very long texts           profiled whole
    ties                      the language first by code point; of lang values with as
                              many documents, the first by code point are learned
    null doc_id               identified, never learned from, held_out false
    repeated rows             each gives its own row
    empty table               empty result
    extra columns             not read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.shared import bucket_of, documents
from resonant.session import ship


@dataclass(frozen=True)
class LanguageConfig:
    dimensions: int = 512
    seed: int = 11
    per_language: int = 2000
    most_languages: int = 512
    sample_tasks: int = 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.int64)


@lru_cache(maxsize=65536)
def _letter_vector(letter: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, letter]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters and gaps, and their counts; empty without letters."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def trigram_vectors(grams: np.ndarray, config: LanguageConfig) -> np.ndarray:
    """One row for each trigram: the product of its letters' permuted vectors."""
    mask = (1 << 21) - 1
    places = [grams >> 42, (grams >> 21) & mask, grams & mask]
    letters = np.unique(np.concatenate(places))
    table = np.array([_letter_vector(int(c), config.dimensions, config.seed) for c in letters], np.int8)
    out = np.roll(table, 2, axis=1)[np.searchsorted(letters, places[0])]
    out *= np.roll(table, 1, axis=1)[np.searchsorted(letters, places[1])]
    out *= table[np.searchsorted(letters, places[2])]
    return out.astype(np.float32)


class Profiler:
    """profiles(texts): a row of unit length for each text, zero for one without letters.

    Vectors of trigrams met are kept, up to most_kept.
    """

    def __init__(self, config: LanguageConfig, most_kept: int = 60_000):
        self.config, self.most_kept = config, most_kept
        self.grams = np.empty(0, np.int64)
        self.vectors = np.empty((0, config.dimensions), np.float32)

    def _know(self, grams: np.ndarray) -> None:
        new = np.setdiff1d(grams, self.grams, assume_unique=True)
        if not len(new):
            return
        if len(self.grams) + len(new) > self.most_kept:
            self.grams, self.vectors = grams, trigram_vectors(grams, self.config)
            return
        all_grams = np.concatenate([self.grams, new])
        order = np.argsort(all_grams, kind="stable")
        self.vectors = np.concatenate([self.vectors, trigram_vectors(new, self.config)])[order]
        self.grams = all_grams[order]

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.config.dimensions), np.float32)
        found = [trigrams(t) if t else None for t in texts]
        met = [f[0] for f in found if f is not None]
        if met:
            self._know(np.unique(np.concatenate(met)))
        for i, f in enumerate(found):
            if f is not None and len(f[0]):
                out[i] = f[1].astype(np.float32) @ self.vectors[np.searchsorted(self.grams, f[0])]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


@lru_cache(maxsize=2)
def shared_profiler(config: LanguageConfig) -> Profiler:
    return Profiler(config)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def learn(train: DataFrame, config: LanguageConfig = LanguageConfig()) -> dict[str, np.ndarray]:
    """A prototype for each lang of train(doc_id, text, lang); rows with null lang or doc_id are passed over."""
    train = train.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(config.most_languages)
    shares = {r["lang"]: min(1.0, config.per_language / r["n"]) for r in counts.collect()}
    if not shares:
        return {}
    wanted = F.create_map(*[F.lit(x) for kv in sorted(shares.items()) for x in kv])
    drawn = F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = train.where(drawn < wanted[F.col("lang")]).repartition(config.sample_tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in _parts(batches):
            vectors = shared_profiler(config).profiles(part.column(0).to_pylist())
            for lang, v in zip(part.column(1).to_pylist(), vectors):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "bundle": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    ship(train.sparkSession)
    prototypes: dict[str, np.ndarray] = {}
    for r in sample.select("text", "lang").mapInArrow(run, "lang string, bundle array<double>").collect():
        prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + np.array(r["bundle"])
    return {k: v / n for k, v in sorted(prototypes.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], config: LanguageConfig = LanguageConfig(), extra: dict | None = None) -> DataFrame:
    """One row per document: doc_id, the columns of extra, lang_pred, score (the cosine, 0 to 1)."""
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs], np.float32).T if langs else np.zeros((config.dimensions, 0), np.float32)
    kept = docs.select("doc_id", *[c.alias(n) for n, c in (extra or {}).items()], "text")
    text_at = len(kept.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            vectors = shared_profiler(config).profiles(part.column(text_at).to_pylist())
            cosines = vectors @ matrix
            best = cosines.argmax(axis=1) if langs else np.zeros(len(part), int)
            known = np.any(vectors != 0, axis=1) & bool(langs)
            pred = [langs[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, np.clip(cosines[np.arange(len(part)), best], 0, 1) if langs else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:text_at], pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], names=[*part.schema.names[:text_at], "lang_pred", "score"])

    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:text_at])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), "", 3) == 1, F.lit(False))
    return identify(docs, learn(docs.where(~held_out)), extra={"held_out": held_out})
