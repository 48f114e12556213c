"""Raw documents to packed training sequences: clean, dedup, mix, pack.

Each stage reads what its predecessor wrote, as Parquet in the shared work folder.

Defined cases, in every stage
    null or empty text    clean, equal to the empty text, in no class of near copies, of
                          no words for the mix (so it leaves there)
    null doc_id           never learned from, loses to any other in a group of equal
                          texts, is the class's row only where it has no other
    repeated rows         equal texts: one stays
    very long texts       scored, hashed, shingled, cut and tokenised whole
    ties                  as each operator has them
    empty table           an empty table of the stage's columns
    extra columns         kept, also those named like an operator's own; the last stage
                          returns pieces
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from resonant.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from resonant.llm.shared import documents, scope, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """Before a stage, the work tables of earlier stages over the same tables go: their result is written."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark, f"pipeline-{zlib.crc32(sf_dir.encode()):08x}", keep=docs):
            return function(spark, docs, sf_dir)

    return run_stage



@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among docs; documents predicted toxic go."""
    machine = toxicity.learn(docs, toxicity.training_labels(spark, sf_dir))
    return toxicity.clean_documents(docs, machine)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.unique_documents(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one document stays."""
    return near_dedup.one_per_class(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix takes, as documents; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Models, minhashes and byte-pair encodings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
