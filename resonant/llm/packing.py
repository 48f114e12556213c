"""Cost-balanced packing of token ids into sequences.

A document's attention cost is linear * n + quadratic * n * n for n tokens. In
descending order of cost, each document goes to the sequence of lowest cost that
still has room for it.

Documents are packed in groups of a bounded number of tokens, in the partition
that read them: nothing is shuffled, a group fits in memory whatever the input,
and a lost task gives the same sequences when it runs again on its rows. What
does not fill its sequences goes on to the partition's next group. Only at the
end of a partition does a sequence stay part-filled; it is cut into runs whose
lengths are powers of two, which need no padding.

Defined cases
    null or empty text    the end id alone
    null doc_id           allowed
    repeated rows         each row is a document of its own
    very long texts       cut into full sequences and a rest, held as one text only
    empty table           empty result
    extra columns         not read
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.shared import documents, text_of
from resonant.llm.tokens import EOS, WordBpe, shared_bpe
from resonant.session import ship


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 4096
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    group_tokens: int = 1 << 20  # tokens that are packed together
    batch_chars: int = 1 << 20  # characters that are tokenised together


@dataclass
class Piece:
    doc: int  # place in the group's list of documents
    start: int
    length: int


def cost(n: int, config: PackConfig) -> float:
    return config.linear * n + config.quadratic * n * n


def assign(pieces: list[Piece], config: PackConfig) -> list[list[Piece]]:
    """Pieces of at most `capacity` tokens to as few sequences as can hold them.

    A document that no sequence can take whole, because the room left is spread
    over several, is cut to fill the emptiest ones.
    """
    total = sum(p.length for p in pieces)
    bins: list[list[Piece]] = [[] for _ in range(-(-total // config.capacity))]
    room = [config.capacity] * len(bins)
    heap = [(0.0, b) for b in range(len(bins))]
    for p in sorted(pieces, key=lambda p: (-cost(p.length, config), p.doc, p.start)):
        aside, spent = [], 0.0
        while heap and room[heap[0][1]] < p.length:
            aside.append(heapq.heappop(heap))
        if heap:
            spent, b = heapq.heappop(heap)
            bins[b].append(p)
            room[b] -= p.length
            aside.append((spent + cost(p.length, config), b))
        else:
            start, left = p.start, p.length
            for b in sorted((b for _, b in aside), key=lambda b: (-room[b], b)):
                n = min(left, room[b])
                if n:
                    bins[b].append(Piece(p.doc, start, n))
                    room[b] -= n
                    start, left = start + n, left - n
        for entry in aside:
            if room[entry[1]]:
                heapq.heappush(heap, entry)
    return fill(bins, room)


def fill(bins: list[list[Piece]], room: list[int]) -> list[list[Piece]]:
    """Cut the emptiest sequence to fill the room of all others; it alone stays part-filled."""
    if not bins:
        return bins
    giver = max(range(len(bins)), key=lambda b: (room[b], -b))
    for b in range(len(bins)):
        while b != giver and room[b]:
            p = bins[giver].pop()
            n = min(p.length, room[b])
            bins[b].append(Piece(p.doc, p.start + p.length - n, n))
            room[b] -= n
            if n < p.length:
                bins[giver].append(Piece(p.doc, p.start, p.length - n))
    return bins


def runs_of_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces, in order, cut into runs whose lengths are falling powers of two."""
    left, runs = sum(p.length for p in pieces), []
    todo = list(reversed(pieces))
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        run = []
        while want:
            p = todo.pop()
            if p.length > want:
                todo.append(Piece(p.doc, p.start + want, p.length - want))
                p = Piece(p.doc, p.start, want)
            run.append(p)
            want -= p.length
        runs.append(run)
    return runs


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.list_(pa.int32()))]
)


def _rows(sequences: list[list[Piece]], docs: list[tuple], first_id: int, with_ids: bool) -> pa.RecordBatch:
    cols: dict[str, list] = {f.name: [] for f in _ARROW}
    for s, pieces in enumerate(sequences):
        at = 0
        for p in pieces:
            doc_id, raw, base, total = docs[p.doc]
            part = raw[4 * p.start : 4 * (p.start + p.length)]
            for name, value in zip(cols, (doc_id, base + p.start, p.length, zlib.crc32(part), total, first_id + s, at)):
                cols[name].append(value)
            cols["ids"].append(np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
            at += p.length
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _documents(batches: Iterator[pa.RecordBatch], bpe: WordBpe, config: PackConfig) -> Iterator[tuple]:
    """(doc_id, ids as bytes), tokenising texts together up to batch_chars."""
    for batch in batches:
        names, texts = batch.column(0), batch.column(1)
        lo = 0
        while lo < len(batch):
            hi, chars, part = lo, 0, []
            while hi < len(batch) and (not part or chars < config.batch_chars):
                part.append(texts[hi].as_py() or "")
                chars += len(part[-1])
                hi += 1
            end = EOS.to_bytes(4, "little")
            for k, raw in enumerate(bpe.encode_batch(part)):
                yield names[lo + k].as_py(), raw + end
            lo = hi


def pack_stream(stream: Iterator[tuple], partition: int, config: PackConfig, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Groups of documents packed one after another; see the module's text."""
    next_id = partition << 40
    docs: list[tuple] = []  # doc_id, bytes, tokens of the document before them, tokens of the document
    held = 0

    def flush(last: bool) -> pa.RecordBatch | None:
        nonlocal docs, held, next_id
        pieces = []
        for d, (_, raw, _, _) in enumerate(docs):
            n = len(raw) // 4
            pieces += [Piece(d, s, min(config.capacity, n - s)) for s in range(0, n, config.capacity)]
        bins = [b for b in assign(pieces, config) if b]
        full = [b for b in bins if sum(p.length for p in b) == config.capacity]
        rest = [b for b in bins if sum(p.length for p in b) < config.capacity]
        if last:
            full += [run for b in rest for run in runs_of_powers(b)]
            carried = []
        else:
            carried = [(docs[p.doc][0], docs[p.doc][1][4 * p.start : 4 * (p.start + p.length)], docs[p.doc][2] + p.start, docs[p.doc][3]) for b in rest for p in b]
        out = _rows(full, docs, next_id, with_ids) if full else None
        next_id += len(full)
        docs = carried
        held = sum(len(raw) // 4 for _, raw, _, _ in docs)
        return out

    for doc_id, raw in stream:
        docs.append((doc_id, raw, 0, len(raw) // 4))
        held += len(raw) // 4
        if held >= config.group_tokens and (out := flush(False)):
            yield out
    if docs and (out := flush(True)):
        yield out


def pack(docs: DataFrame, vocabulary: str, config: PackConfig = PackConfig(), with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    vocabulary is the path of the tokenizer's file on every machine. with_ids=False
    leaves the column ids null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from pack_stream(_documents(batches, shared_bpe(vocabulary), config), TaskContext.get().partitionId(), config, with_ids)

    ship(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path(), with_ids=False).drop("ids")
