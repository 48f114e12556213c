import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x)], SCHEMA)


def recall(got, x, ids, k=20):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = []
    for q, rows in by.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-9) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits.append(len({r.vec_id for r in rows} & set(np.argsort(-s, kind="stable")[:k].tolist())) / k)
    return np.mean(hits), len(by)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, scaled):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.5, 1.5, (3000, 1)).astype(np.float32)
    got = nn.search(nn.build(frame(spark, x)), F.col("vec_id") % 20 == 0).collect()
    found, queries = recall(got, x, None)
    assert queries == 150 and found >= 0.9


def test_identical_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    x[50:150] = x[50]
    got = nn.search(nn.build(frame(spark, x)), F.col("vec_id") == 60).collect()
    first = [r.vec_id for r in sorted(got, key=lambda r: r.rank)]
    assert len(first) == 20 and all(50 <= v < 150 and v != 60 for v in first) and first == sorted(first)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (8, []), (20, [2.0, 0.0]), (1, [0.5, 0.5])]
    got = nn.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 1, 1.0)]


def test_null_ids_and_other_lengths_are_candidates(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (None, [1.0, 1.0], 1, 1), (3, [1.0, 2.0], 1, 1), (40, [1.0, 1.0, 1.0], 1, 1), (7, [0.0, 0.0, 2.0], 1, 1), (None, [3.0, 0.0, 0.0], 1, 1), (60, [5.0], 1, 1)]
    given = spark.createDataFrame(rows, SCHEMA + ", uid long, node long")
    got = nn.nearest(given, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 3, 1.0), (0, 2, None, 1.0), (40, 1, None, 3.0), (40, 2, 7, 2.0)]
    with pytest.raises(ValueError):
        nn.build(given)


def test_descent_finds_what_the_first_neighbours_lack(spark, monkeypatch):
    """Recall of the graph round by round: the start has little, the rounds bring it to nine tenths."""
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.standard_normal((n, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sample = rng.choice(n, 200, replace=False)
    sims = x[sample] @ x.T
    sims[np.arange(200), sample] = -np.inf
    best = [set(np.argpartition(-s, 20)[:20].tolist()) for s in sims]
    rounds, written = [], nn.written

    def watched(df, label):
        out = written(df, label)
        if label == "ann-near":
            near = {r.node: set(r.near) for r in out.where(F.col("node").isin([names[int(i)] for i in sample])).collect()}
            rounds.append(np.mean([len({names[j] for j in b} & near[names[int(i)]]) / 20 for i, b in zip(sample, best)]))
        if label == "ann-named":
            names.update({r.vec_id: r.uid for r in out.select("vec_id", "uid").collect()})
        return out

    names = {}
    monkeypatch.setattr(nn, "written", watched)
    nn.build(frame(spark, x), nn.NeighbourConfig(orders=2, window=16, window_best=8))
    assert rounds[0] < 0.2 and rounds == sorted(rounds) and rounds[-1] > 0.9 and len(rounds) >= 4


def test_long_vectors_near_to_everything(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[:10] *= 30
    got = nn.nearest(frame(spark, x), F.col("vec_id") % 20 == 0).collect()
    found, queries = recall(got, x, None)
    assert queries == 75 and found >= 0.9


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = {}
    for r in nn.op8_nearest_neighbours(spark, data).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = []
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(v - s[ids == i][0]) < 1e-12 for _, i, v in found)
        hits.append(len({i for _, i, _ in found} & set(ids[want].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_empty(spark):
    assert nn.search(nn.build(spark.createDataFrame([], SCHEMA)), F.col("vec_id") % 20 == 0).collect() == []
    assert nn.nearest(spark.createDataFrame([(0, [0.0])], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
