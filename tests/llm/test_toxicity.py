import random
import zlib
from dataclasses import replace

import numpy as np

from resonant.llm import toxicity as t


def corpus(n, seed=1):
    """Toxic only where an insult and a group come together."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(300):03d}z" for _ in range(rng.randint(5, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["insultword"] * insult + ["groupname"] * group
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(insult and group)))
    return rows


def test_pairs_are_learned():
    c = t.ToxicityConfig(prefixes=())
    rows = corpus(3000)
    machine = t.fit([t.features(x, c) for _, x, _ in rows[:2000]], np.array([y for *_, y in rows[:2000]]), c)
    scorer = t.Scorer(machine, c)
    right = [(scorer.score(x) >= 0.3) == bool(y) for _, x, y in rows[2000:]]
    assert np.mean(right) > 0.97
    alone, both = scorer.score("insultword w001z"), scorer.score("insultword groupname w001z")
    assert alone < 0.3 < both


def test_scorer_equals_features():
    """A text's score is the machine's on the text's features."""
    c = t.ToxicityConfig(prefixes=(2, 3))
    rows = corpus(600)
    machine = t.fit([t.features(x, c) for _, x, _ in rows], np.array([y for *_, y in rows]), c)
    scorer = t.Scorer(machine, c, most_kept=50)
    assert len(machine.ids)
    for x in [*(x for _, x, _ in rows[:100]), None, "", "w001z w002z w003z w004z groupname groupnames insultword", "É" * 1000]:
        places = np.flatnonzero(np.isin(machine.ids, t.features(x, c)))
        assert abs(scorer.score(x) - 1 / (1 + np.exp(-machine.logit(places)))) < 1e-12


def weak_pairs(n, seed=2):
    """Two words that say nothing on their own: toxic where both or neither come."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(200):03d}z" for _ in range(rng.randint(5, 30))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultword"] * a + ["groupname"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(a and b) if rng.random() < 0.97 else 0) if a or b else (k, " ".join(words), int(rng.random() < 0.5)))
    return rows


def test_a_pair_without_support_of_its_own_is_learned():
    c = t.ToxicityConfig(prefixes=())
    rows = weak_pairs(4000)
    found, labels = [t.features(x, c) for _, x, _ in rows], np.array([y for *_, y in rows])
    ids, z = t.ranked_terms(found, labels, c)
    terms = {w: t.word_features(w, c)[0] for w in ("insultword", "groupname")}
    strict = replace(c, least_z=float(max(z)) + 1)  # nothing is strong enough alone
    chosen = t.support(ids, z, found, labels, strict)
    assert set(terms.values()) <= set(chosen.tolist()) and len(chosen) < 20
    scorer = t.Scorer(t.fit(found, labels, strict), strict)
    assert scorer.score("insultword groupname w001z") > 0.5 > 0.3 > scorer.score("insultword w001z") and scorer.score("groupname w001z") < 0.3


def test_terms_are_ranked_in_spark_as_in_memory(spark):
    c = t.ToxicityConfig(most_features=50, pair_terms=30)
    rows = corpus(500)
    found, labels = [t.features(x, c) for _, x, _ in rows], np.array([y for *_, y in rows])
    df = spark.createDataFrame([(k, int(y), f.tobytes()) for (k, *_), y, f in zip(rows, labels, found)], "doc_id long, toxic int, ids binary")
    ids, z = t._ranked_in_spark(df, c)
    want_ids, want_z = t.ranked_terms(found, labels, c)
    assert len(ids) == 80 and np.allclose(z, want_z) and set(ids[z > z[-1] + 1e-9].tolist()) == set(want_ids[want_z > want_z[-1] + 1e-9].tolist())


def test_repeated_ids_are_one_sample_row(spark, docs):
    given = docs(["a b c"] * 50 + ["d e"], ids=[1] * 50 + [2])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    fit, t.fit = t.fit, lambda rows, y, *rest: seen.append((len(rows), y.tolist())) or fit(rows, y, *rest)
    try:
        t.learn(given, labels)
    finally:
        t.fit = fit
    assert seen == [(2, [1, 0])]


def test_query_against_the_contract(spark):
    data = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = t.op10_toxicity(spark, data).collect()
    assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == y for p, y in held) / len(held) > 0.92 and not any(p > y for p, y in held)


def test_empty_table(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert t.learn(docs([]), labels) is None and t.score(docs([]), None).collect() == []


def test_spark_round_trip(spark, docs):
    rows = corpus(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = t.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in t.score(df.select("doc_id", "text"), machine).collect()}
    scorer = t.Scorer(machine, t.ToxicityConfig())
    assert all(abs(got[k] - scorer.score(x)) < 1e-12 for k, x, _ in rows)
    edge = docs([None, "", "w" * 300_000, "insultword groupname"], ids=[1, None, 3, 3], score=["z"] * 4)
    assert [0 <= r.score <= 1 for r in t.score(edge, machine).collect()] == [True] * 4
    clean = t.clean_documents(edge, machine)
    assert clean.columns == edge.columns and [r.text for r in clean.collect()] == [None, "", "w" * 300_000]


def test_no_labels(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert t.learn(docs(["a"]), none) is None
    assert [(r.score, r.predicted) for r in t.score(docs(["a"]), None).collect()] == [(0.0, 0)]
    one = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    assert t.score(docs(["a"]), t.learn(docs(["a"]), one)).first().predicted == 0
