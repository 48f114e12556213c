import random

import pytest

from resonant.llm.components import Forest, components


def by_hand(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("kind", ["random", "chain", "star", "backwards"])
def test_against_labels_by_hand(spark, kind):
    rng = random.Random(1)
    order = list(range(60))
    rng.shuffle(order)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "chain": list(zip(order, order[1:])),
        "star": [(59, k) for k in range(59)],
        "backwards": [(k + 1, k) for k in range(40)] * 2,
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, component long")).collect()}
    want = by_hand([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_forest_keeps_what_connects():
    rng = random.Random(2)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(200)]
    forest = Forest()
    kept = [e for e in edges if forest.joins(*e)]
    assert len(kept) < 50 and by_hand(kept).items() <= by_hand(edges).items()
    small = Forest(most=5)  # forgets, and then only keeps more
    assert by_hand([e for e in edges if small.joins(*e)]).items() <= by_hand(edges).items()
