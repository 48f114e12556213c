import zlib

import corpus_pipeline
from resonant.llm import exact_dedup, near_dedup, registry, toxicity
from resonant.llm.packing import vocabulary_path
from resonant.llm.tokens import WordBpe

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_checks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    clean = stages["toxicity"](spark, docs, DATA)
    machine = toxicity.learn(docs, toxicity.training_labels(spark, DATA))
    scorer = toxicity.Scorer(machine, toxicity.ToxicityConfig())
    kept = {k for k, r in given.items() if scorer.score(r.text) < 0.3}
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == columns
    unique = stages["exact dedup"](spark, clean, DATA)
    best = {}
    for k in kept:
        t = given[k].text.encode().lower()
        best[t] = max(k, best.get(t, -1))
    assert {r.doc_id for r in unique.collect()} == set(best.values()) and unique.columns == columns
    one = stages["n-gram Jaccard join"](spark, unique, DATA)
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(unique).collect()}
    stays = [classes[r.doc_id] for r in one.collect()]
    assert sorted(stays) == sorted(set(classes.values())) and one.columns == columns
    mixed = stages["mixing sources to target weights"](spark, one, DATA)
    assert mixed.columns == columns
    rows = mixed.collect()
    assert {r.doc_id for r in rows} <= set(classes)
    packed = stages["packing"](spark, mixed, DATA).collect()
    bpe = WordBpe(vocabulary_path())
    assert sum(r.length for r in packed) == sum(len(x) // 4 + 1 for x in bpe.encode_batch([r.text for r in rows]))
    for r in packed:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_registry():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES) and exact_dedup.SQL == registry.ORACLES["op5_exact_dedup"]


def test_stages_on_odd_tables(spark, docs):
    """Nulls, empty texts, repeated rows, very long texts and clashing names; and no rows at all."""
    names = "size target row_no class_id kept digest node score shard sid text_hash uid".split()
    texts = ["a b c d e f g", "a b c d e f g", "A b c d e f g", None, "", "long " * 60_000, "one two three four five six", "one two three four five six!", " \t"]
    n = len(texts)
    given = docs(texts, ids=[1, 1, 2, None, None, 5, 6, 7, None], sources=[None, "s", "s", None, "s", "s", "t", "t", "t"], langs=[None] * n, **{c: [c[:1]] * n for c in names})
    for table in (given, given.where("false")):
        now = table
        for name, step in corpus_pipeline.STAGES[:-1]:
            now = step(spark, now, DATA)
            assert now.columns == given.columns
            rows = now.collect()
            assert all(r.size == "s" and r.uid == "u" for r in rows)
            if name == "exact dedup" and rows:
                assert sorted((r.text or "").lower()[:20] for r in rows) == sorted(["a b c d e f g", "", "long long long long ", "one two three four f", "one two three four f", " \t"])
            if name == "n-gram Jaccard join" and rows:
                assert sum((r.text or "").startswith("one") for r in rows) == 1
            now = spark.createDataFrame(rows, given.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
        assert bool(packed) == (table is given)
        assert {r.doc_id for r in packed} <= {1, 2, None, 5, 6, 7}
