import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from resonant.llm import packing as p
from resonant.llm.tokens import WordBpe

BPE = WordBpe(p.vocabulary_path())
ODD = ["", "İstanbul Σας don't 3½²  x\x85y\xa0z µª", "a\x1cb", "éa", "it's we'll 'tis <|x|>", "ÀÉß ÿŸ", "<|endoftext|> a", "'start 're've'll,'s ''s x'", "a's's 12'm '", "K ẞ", "日本 é"]


def whole(text):
    return BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    assert [np.frombuffer(x, "<u4").tolist() for x in BPE.encode_batch(ODD)] == [whole(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abéÉß'’stmdrevl 1½.,\t\n\x1cİ<|>"), max_size=30), max_size=6))
def test_ids_equal_on_any_text(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in BPE.encode_batch(texts)] == [whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=60))
def test_assignment_loses_nothing_and_leaves_one_open(lengths):
    config = p.PackConfig()
    bins = p.assign([p.Piece(k, 0, n) for k, n in enumerate(lengths)], config)
    assert len(bins) == -(-sum(lengths) // 4096)
    assert sum(sum(x.length for x in b) != 4096 for b in bins) <= 1
    for k, n in enumerate(lengths):
        at = 0
        for x in sorted((x for b in bins for x in b if x.doc == k), key=lambda x: x.start):
            assert x.start == at
            at += x.length
        assert at == n


def test_lowest_cost_sequence_takes_the_next_document():
    config = p.PackConfig(capacity=100)
    bins = p.assign([p.Piece(0, 0, 60), p.Piece(1, 0, 50), p.Piece(2, 0, 40), p.Piece(3, 0, 50)], config)
    assert sorted(sorted(x.length for x in b) for b in bins) == [[40, 60], [50, 50]]


def check(rows, texts, capacity=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [*whole(texts[doc] or ""), 2]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == part
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    return by_sequence


def test_round_trip(docs):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice(["the", "ouverture", "größe", "x1"]) for _ in range(rng.choice([0, 3, 200, 9000]))) for k in range(60)} | {60: None, 61: "", 62: "日本"}
    got = p.pack(docs(list(texts.values()), ids=list(texts)), p.vocabulary_path(), p.PackConfig(group_tokens=20_000)).collect()
    check(got, texts)


def test_repeated_and_null_ids_and_empty_table(docs):
    got = p.pack(docs(["a b", "a b", "c"], ids=[4, 4, None]), p.vocabulary_path()).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 6 and sum(r.length for r in got if r.doc_id is None) == 2
    assert p.pack(docs([]), p.vocabulary_path()).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4095])
def test_runs_of_powers(n):
    sizes = [sum(x.length for x in run) for run in p.runs_of_powers([p.Piece(0, 0, n // 2), p.Piece(1, 0, n - n // 2)])]
    assert sum(sizes) == n and all(s & (s - 1) == 0 for s in sizes) and len(set(sizes)) == len(sizes)


def test_query_against_the_tokenizer(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {k: [*whole(t or ""), 2] for k, t in texts.items()}
    rows = p.op3_cost_packing(spark, data).collect()
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, size in [(pieces[k], len(x)) for k, x in ids.items()] + [(s, sum(n for _, n in s)) for s in sequences.values()]:
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) == size
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 4096
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in sizes)
    assert padded <= 1.02 * sum(sizes)


def test_clashing_columns_and_repeated_rows(spark, docs):
    texts = ["a b c", "a b c", None, "", "x " * 20_000]
    extra = {c: ["z"] * 5 for c in ("start", "length", "offset", "sequence_id")}
    got = p.pack(docs(texts, ids=[1, 1, None, None, 2], **extra).withColumn("ids", F.lit("z")), p.vocabulary_path()).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.length)
    assert sum(by[1]) == 2 * (len(whole("a b c")) + 1) and sum(by[None]) == 2 and sum(by[2]) == len(whole(texts[4])) + 1
