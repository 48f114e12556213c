import hashlib

from resonant.llm import exact_dedup as d

TEXTS = ["Abc", "aBC", None, "", "É", "é", "x" * 200_000, "Abc", "abc"]


def test_groups_and_digests(docs):
    got = {r.row_no: r for r in d.dedup(docs(TEXTS, ids=[1, 2, 3, 4, 5, 6, 7, 8, 8])).collect()}
    rows = sorted(got.values(), key=lambda r: r.row_no)
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    by_digest = {}
    for r in rows:
        by_digest.setdefault(r.text_sha256, []).append(r)
    assert set(by_digest) == {hashlib.sha256(fold(t).encode()).hexdigest() for t in TEXTS}
    for group in by_digest.values():
        assert {r.group_size for r in group} == {len(group)}
        assert {r.keep_id for r in group} == {max(r.doc_id for r in group)}
        assert sum(r.kept for r in group) == 1  # also of the two rows with doc_id 8


def test_null_ids_and_empty_table(docs):
    got = d.dedup(docs(["a", "a", "b"], ids=[None, 3, None])).collect()
    assert sorted((r.keep_id, r.kept) for r in got if r.group_size == 2) == [(3, False), (3, True)]
    assert [(r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, True)]
    assert d.dedup(docs([])).collect() == []


def test_index_is_kept_between_batches(spark, docs):
    index = d.open_index(spark, 10)
    d.dedup(docs(["a", "b"], ids=[1, 2]), index).collect()
    assert index.table().count() == 2
    got = {r.doc_id: (r.keep_id, r.kept) for r in d.dedup(docs(["A", "c"], ids=[7, 8]), index).collect()}
    assert got == {7: (1, False), 8: (8, True)}
    d.dedup(docs(["A", "c"], ids=[7, 8]), index).collect()
    assert index.table().count() == 3
    anti = index.table().hint("merge").join(index.table().select("digest"), "digest", "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_unique_documents_keep_columns_once(docs):
    given = docs(["a", "A", "b", "b", None], ids=[1, 2, 3, 3, None], digest=list("pqrst"), kept=list("pqrst"))
    got = d.unique_documents(given)
    assert got.columns == given.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, ""), (2, "A"), (3, "b")]


def test_batches_against_one_index(spark, docs, monkeypatch):
    """Copies in a later batch fall to the anti-join, and to nothing else."""
    texts = ["a", "b", "A", "c", "b", None, "", "d", "d"]
    given = docs(texts, ids=[1, 2, 3, 4, 5, None, 6, 9, 9])
    want = {r.row_no: r.asDict() for r in d.dedup(given).collect()}
    index = d.open_index(spark, 10)
    batch = d.larger_ids_first(given, 3)
    assert sorted(r[0] for r in given.select(batch).collect()) == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    got = {r.row_no: r.asDict() for r in d.dedup(given, index, batch, 3).collect()}
    assert got == want
    assert index.table().count() == 5
    again = d.dedup(given, index, batch, 3).collect()
    assert not any(r.kept for r in again) and {r.row_no: r.keep_id for r in again} == {k: r["keep_id"] for k, r in want.items()}
    assert index.table().count() == 5
    index.close()
    # without the anti-join, a row stays in each batch
    monkeypatch.setattr(d.DigestIndex, "append", lambda self, groups: groups)
    index = d.open_index(spark, 10)
    monkeypatch.setattr(d.DigestIndex, "table", lambda self: d.written(rows, "test-index"))
    rows = given.select(d.digest_of(d.text_of()).alias("digest"), d.F.lit(0).cast("long").alias("keep_id")).distinct()
    assert sum(r.kept for r in d.dedup(given, index, batch, 3).collect()) > 5


def test_the_query_leaves_no_table(spark):
    data = "/root/testdata/sf0.001"
    before = spark.catalog.listTables()
    rows = d.op5_exact_dedup(spark, data).collect()
    assert spark.catalog.listTables() == before
    by = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        by.setdefault("".join(c.lower() if c.isascii() else c for c in r.text or ""), []).append(r.doc_id)
    want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want
