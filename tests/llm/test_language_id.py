import random
import zlib

import numpy as np

from resonant.llm import language_id as lid

VOICE = {"aa": "ta pa ka lo mi", "bb": "strunz gral pfed knolp", "cc": "ñe ós íra que lle"}


def corpus(n):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        lang = rng.choice(list(VOICE))
        rows.append((k, " ".join("".join(rng.choices(VOICE[lang].split(), k=2)) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    from pyspark.sql import functions as F

    from resonant.llm.shared import bucket_of

    train = df.where(bucket_of(F.col("doc_id"), "", 3) != 1)
    got = {r.doc_id: r for r in lid.identify(df, lid.learn(train)).collect()}
    right = [got[k].lang_pred == lang for k, _, lang in corpus(600) if held(k)]
    assert len(right) > 100 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, docs):
    p = lid.learn(docs(["ta pa ka", "strunz gral", "x"], langs=["aa", "bb", None]))
    assert list(p) == ["aa", "bb"]
    got = lid.identify(docs([None, "", "12 !?", "ta ka", "日本", "ta" * 100_000], score=["z"] * 6), p).collect()
    assert [r.lang_pred for r in got[:4]] == ["und", "und", "und", "aa"] and [r.score for r in got[:3]] == [0, 0, 0]
    assert got[4].lang_pred in p and len(got) == 6
    assert {r.lang_pred for r in lid.identify(docs(["a"]), lid.learn(docs([]))).collect()} == {"und"}


def test_trigram_vectors_bind_in_order():
    c = lid.LanguageConfig()
    abc, acb = (lid.trigram_vectors(lid.trigrams(t)[0], c) for t in ("abc", "acb"))
    assert abs(abc[1] @ acb[1]) < 0.3 * c.dimensions and set(np.unique(abc)) == {-1.0, 1.0}


def test_query_against_the_contract(spark):
    import zlib

    data = "/root/testdata/sf0.01"
    given = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = lid.op6_language_id(spark, data).collect()
    langs = {r.lang for r in given.values() if r.lang}
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in given[r.doc_id].text or "")
        assert r.lang_pred in langs if letters else (r.lang_pred == "und" and r.score == 0)
    held = [r.lang_pred == given[r.doc_id].lang for r in rows if r.held_out and given[r.doc_id].lang]
    assert sum(held) / len(held) > 0.97


def test_odd_rows(spark, docs):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "12 !", "the cat and the dog", "the " * 100_000]
    given = docs(texts, ids=[1, 2, None, 4, 5, 1, None], langs=["en", "de", "en", None, "en", "en", None], lang_pred=["z"] * 7, score=["z"] * 7)
    prototypes = lid.learn(given)
    assert sorted(prototypes) == ["de", "en"]
    got = [(r.lang_pred, r.score > 0) for r in lid.identify(given, prototypes).collect()]
    assert got == [("en", True), ("de", True), ("und", False), ("und", False), ("und", False), ("en", True), ("en", True)]
    # of lang values that are too many, those with most documents are learned
    assert list(lid.learn(given, lid.LanguageConfig(most_languages=1))) == ["en"]
    # a tie goes to the language first by code point
    same = {"aa": prototypes["en"], "bb": prototypes["en"]}
    assert {r.lang_pred for r in lid.identify(given.where("doc_id = 1"), dict(sorted(same.items()))).collect()} == {"aa"}
    assert lid.identify(docs([]), prototypes).collect() == []
