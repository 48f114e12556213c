import textwrap

import duckdb
import pytest

from resonant.llm import licence_texts as TEXTS_OF
from resonant.llm import license_scan as ls
from resonant.llm import token_counts as tc
from resonant.llm.packing import vocabulary_path
from resonant.llm.shared import scratch

TEXTS = [
    "Some prose.\nLicensed under the Apache License, Version 2.0.",
    "Released under the MIT License. All rights reserved.",
    "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction. And more. The software is provided \"as is\", without warranty of any kind.",
    "all  RIGHTS\treserved!\n\nall rights reserved",
    "We reserve all rights", None, "", "x" * 200_000 + "\nlicensed under CC BY-NC 4.0.",
]


def test_rules(docs):
    got = {r.doc_id: (r.licences, r.sentences, r.matches) for r in ls.scan(docs(TEXTS, licences=["z"] * len(TEXTS))).collect()}
    assert got == {0: ("Apache-2.0", 1, 1), 1: ("MIT+Proprietary", 2, 2), 2: ("Apache-2.0", 2, 1), 3: ("MIT", 2, 1), 4: ("Proprietary", 2, 2), 5: ("", 0, 0), 6: ("", 0, 0), 7: ("", 0, 0), 8: ("CC-BY-NC-4.0", 1, 1)}


def test_order_of_rules_and_sequences(docs):
    known = ls.LicenceRules({"a": "first licence sentence", "b": "second licence sentence"}, [("AB", ["a", "b"]), ("A", ["a"])])
    texts = ["First licence sentence.\nSecond licence sentence.", "First licence sentence.\nOther.\nSecond licence sentence.", "second licence sentence. first licence sentence. second licence sentence"]
    assert [r.licences for r in ls.scan(docs(texts), known).collect()] == ["AB", "A", "AB"]


def test_any_sentence_is_found(spark, docs):
    known = ls.LicenceRules({"u": "this is free and unencumbered software released into the public domain"}, [("Unlicense", ["u"])])
    given = docs(["Prose.\nThis is free and unencumbered software released into the public domain.", "Prose."])
    documents = given.toPandas()  # noqa: F841
    got = [tuple(r) for r in ls.scan(given, known).collect()]
    assert sorted(got) == sorted(duckdb.sql(ls.oracle(known)).fetchall()) == [(0, "Unlicense", 1, 1), (1, "", 0, 0)]
    assert [r.licences for r in ls.scan(docs(["All RIGHTS\treserved.", "all rights\u00a0reserved"])).collect()] == ["Proprietary", "Proprietary"]


WRAPPED = {
    " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required": ("Apache-2.0", 3, 1),
    "# Licensed under the Apache License,\r\n# Version 2.0 (the License);\r\n# you may not use this file except\r\n# in compliance with the License.": ("Apache-2.0", 2, 1),
    "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction.\n": ("MIT", 1, 1),
    "Prose\n    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n": ("GPL-3.0-or-later", 1, 1),
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n": ("BSD", 1, 1),
    "not all rights\nreserved": ("", 0, 0),
    "All rights.\nreserved": ("", 0, 0),
    "Licensed under the MIT License.\n...\nAll rights\nreserved": ("MIT+Proprietary", 2, 2),
}


def test_wrapped_sentences(docs):
    got = ls.scan(docs(list(WRAPPED))).orderBy("doc_id").collect()
    assert [(r.licences, r.sentences, r.matches) for r in got] == list(WRAPPED.values())


def whole_texts():
    """Public licence texts and notices, by licence."""
    out = [(name, text) for name, _, text in TEXTS_OF.TEXTS]
    out += [(name, TEXTS_OF.gnu_notice(*rest)) for name, *rest in TEXTS_OF.GNU_NOTICES]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    return [*out, ("Apache-2.0", apache)]


def wrapped(text, width, mark=""):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part.strip(), width), ""]]
    return "\n".join((mark + line).rstrip() for line in lines)


def test_whole_licence_texts(docs):
    given = []
    for name, text in whole_texts():
        over = f"Copyright (c) 2021 Some Holder\n\n{text}"
        given += [(name, t) for t in (text, over, f"Prose before it, as ever.\n\n{wrapped(over, 76)}\n\nProse after it.", wrapped(text, 60, " * "), wrapped(text, 50, "# "), wrapped(text, 72, "// ").replace("\n", "\r\n"), text.replace("\n\n", " "))]
    assert len({name for name, _ in given}) >= 16
    got = ls.scan(docs([t for _, t in given])).orderBy("doc_id").collect()
    assert [(r.licences, r.matches) for r in got] == [(name, 1) for name, _ in given]
    assert all(r.sentences >= 2 for (name, t), r in zip(given, got) if "." in t.rstrip(".")[:-80] and name != "EPL-2.0")


def test_whole_texts_with_titles(docs):
    given = [(name, f"{title}\n\nCopyright (c) 2019-2022, The Authors. All rights reserved.\n\n{text}") for name, title, text in TEXTS_OF.TEXTS]
    got = ls.scan(docs([t for _, t in given])).orderBy("doc_id").collect()
    assert [(r.licences, r.matches) for r in got] == [(name, 1) for name, _ in given]
    titles = [t for _, t in TEXTS_OF.GNU_TITLES]
    got = ls.scan(docs([t.replace(" Version", "\n   Version") for t in titles])).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [name for name, _ in TEXTS_OF.GNU_TITLES]


def test_cases(docs):
    given = docs(["All rights reserved.", "All rights reserved.", None], ids=[None, None, 4], sentences=list("xyz"))
    assert sorted((r.doc_id or 0, r.licences) for r in ls.scan(given).collect()) == [(0, "Proprietary"), (0, "Proprietary"), (4, "")]
    assert ls.scan(docs([])).collect() == []
    assert "Python" not in ls.scan(given)._jdf.queryExecution().executedPlan().toString()


def test_every_sentence_has_one_of_the_words():
    words = ls.DEFAULT.words
    assert all(set(words) & set(s.split(" ")) for s in ls.DEFAULT.sentences.values()) and len(words) < 20


def test_sql_gives_the_same(spark, docs):
    given = docs(TEXTS)
    documents = given.toPandas()  # noqa: F841
    want = duckdb.sql(ls.SQL.replace("FROM documents", "FROM documents")).fetchall()
    got = [tuple(r) for r in ls.scan(given).select("doc_id", "licences", "sentences", "matches").collect()]
    assert sorted(got) == sorted(want)


def test_rollup_equals_recount(spark, docs):
    roll = tc.Rollup(spark, scratch(spark, "test-rollup"))
    texts, sources = ["a b c", "d", None, "e f", ""], ["s", "s", None, "t", "t"]
    count = tc.by_words()
    given = docs(texts, sources=sources, langs=["en", None, "en", "en", "en"], tokens=["z"] * 5)
    assert roll.totals().collect() == []
    assert roll.commit("one", tc.inserts(count(given)))
    assert not roll.commit("one", tc.inserts(count(given)))
    assert {(r.source, r.lang, r.documents, r.tokens) for r in roll.totals().collect()} == {("s", "en", 1, 3), ("s", None, 1, 1), (None, "en", 1, 0), ("t", "en", 2, 2)}
    from pyspark.sql import functions as F

    revised = tc.by_words(carry={"old_tokens": F.regexp_count("text", F.lit(r"[^ ]+")).cast("long")})(docs(["e f"], sources=["t"])).withColumn("tokens", F.lit(7).cast("long"))
    roll.commit("two", tc.revisions(revised))
    roll.commit("three", tc.deletes(count(docs(["d"], sources=["s"], langs=[None]))))
    roll.commit("empty", tc.inserts(count(docs([]))))
    assert {(r.source, r.lang, r.documents, r.tokens) for r in roll.totals().collect()} == {("s", "en", 1, 3), (None, "en", 1, 0), ("t", "en", 2, 7)}
    assert not roll.commit("three", tc.deletes(count(docs(["d"], sources=["s"], langs=[None]))))
    assert roll.version()[:2] == (4, "empty")
    with pytest.raises(ValueError):
        roll.commit("../x", tc.inserts(count(given)))


def test_versions(spark, docs):
    roll = tc.Rollup(spark, scratch(spark, "test-rollup"))
    change = tc.inserts(tc.by_words()(docs(["a b"])))
    for k in range(6):
        assert roll.commit(f"b{k}", change)
    names = lambda folder: [f.getPath().getName() for f in roll._fs.listStatus(roll._path(folder)) if f.getPath().getName()[0].isdigit()]
    # what a commit reads and the driver lists does not grow with the batches before
    assert len(names("log")) == len(names("totals")) == roll.KEEP
    # a writer that loses the race adds its sums to the winner's totals
    other, real, lost = tc.Rollup(spark, roll.location), roll._create, []

    def late(name, content=""):
        if name.startswith("log") and not lost:
            lost.append(name)
            assert other.commit("winner", change)
        return real(name, content)

    roll._create = late
    assert roll.commit("loser", change)
    assert lost and [(r.documents, r.tokens) for r in other.totals().collect()] == [(8, 16)]
    # a writer lost between the log and the batch's mark has committed
    roll._create = real
    roll._fs.delete(roll._path("batches/loser"), False)
    assert not tc.Rollup(spark, roll.location).commit("loser", change)
    # a writer lost while it wrote its entry has not
    roll._create(f"log/{roll.version()[0] + 1:012d}")
    with pytest.raises(tc.Unfinished):
        roll.commit("next", change)
    roll.recover()
    assert roll.commit("next", change) and [r.documents for r in roll.totals().collect()] == [9]


def test_nulls_and_long_texts(spark, docs):
    roll = tc.Rollup(spark, scratch(spark, "test-rollup"))
    given = docs([None, "a " * 200_000, "b", "b"], ids=[None, None, 3, 3], langs=[None] * 4, sources=[None] * 4, version=["z"] * 4)
    roll.commit("one", tc.inserts(tc.by_words()(given)))
    assert [tuple(r) for r in roll.totals().collect()] == [(None, None, "words-1", 4, 200_002)]
    roll.commit("gone", tc.deletes(tc.by_words()(given)))
    assert roll.totals().collect() == []


def test_the_query_against_recounts(spark):
    data = "/root/testdata/sf0.001"
    rows = tc.op9_token_counts(spark, data).collect()
    assert {r.version for r in rows} == {"words-1", "word-bpe-49k-1"}
    documents = duckdb.sql(f"SELECT * FROM '{data}/documents.parquet'")  # noqa: F841
    assert {tuple(r) for r in rows if r.version == "words-1"} == set(duckdb.sql(tc.WORDS_SQL).fetchall())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        n, size = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = (n + 1, size + len(t.encode(r.text or "", add_special_tokens=False).ids))
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in rows if r.version != "words-1"} == want


def test_word_pieces(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    texts = ["hello world, it's me", "größe 12", None]
    got = tc.by_word_bpe(vocabulary_path())(docs(texts)).collect()
    assert [r.tokens for r in got] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_the_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    documents = duckdb.sql(f"SELECT * FROM '{data}/documents.parquet'")  # noqa: F841
    got = [tuple(r) for r in ls.op4_license_scan(spark, data).select("doc_id", "licences", "sentences", "matches").collect()]
    assert sorted(got) == sorted(duckdb.sql(ls.SQL).fetchall()) and any(r[1] for r in got)
