import random
import re

import pytest

from resonant.llm import mixing as m


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 900))) for _ in range(n)]


def brute_targets(sizes, most=3, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left = {}, set(names)
    total = sum(sizes.values())
    while left:
        free = total - sum(out.values())
        share = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            out.update(share)
            break
        out.update({s: float(most * sizes[s]) for s in over})
        left -= set(over)
    return out


def test_targets_shares_and_limits(docs):
    t = texts(120) + ["one two"] * 3 + [None, "", " \t"]
    sources = (["big", "mid", None] * 40) + ["tiny"] * 3 + ["void"] * 3
    config = m.MixConfig(block_words=16)
    got = m.taken(m.mix(docs(t, sources=sources), config)).collect()
    sizes, taken = {}, {}
    for r in got:
        s = sources[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t[r.doc_id] or ""))
        assert r.taken <= 3 * r.size
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[sources[r.doc_id]]
        assert r.target == pytest.approx(want[sources[r.doc_id]])
    for s in ("big", "mid", None):
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    assert len(got) == len(t)


def test_shards_and_slots_fit_together(docs):
    config = m.MixConfig(block_words=16, shard_slots=64)
    mix = m.mix(docs(texts(60), sources=list("abc") * 20), config)
    sources = {r.sid: r for r in mix.sources.collect()}
    slots = {}
    for r in mix.slots.collect():
        slots.setdefault(r.sid, []).append((r.slot, r.place))
    for sid, s in sources.items():
        assert sorted(k for k, _ in slots[sid]) == list(range(s.slots))
        assert all(place == k % s.blocks for k, place in slots[sid])
    order = {}
    for r in mix.order.collect():
        order.setdefault(r.sid, {})[r.place] = r.block
    for sid, s in sources.items():
        assert sorted(order[sid]) == sorted(order[sid].values()) == list(range(s.blocks))
    counts = {}
    for r in mix.counts.collect():
        counts.setdefault(r.shard, {})[r.sid] = r["count"]
    assert len({tuple(sorted(c.items())) for c in counts.values()}) > 1  # drawn, not dealt evenly


def test_every_shard_is_mixed(docs):
    config = m.MixConfig(block_words=8, shard_slots=64)
    mix = m.mix(docs(texts(90), sources=["a", "b", "c"] * 30), config)
    slots = {r.sid: r.slots for r in mix.sources.collect()}
    counts = {}
    for r in mix.counts.collect():
        counts.setdefault(r.shard, {})[r.sid] = r["count"]
    total = sum(slots.values())
    assert sorted(counts) == list(range(-(-total // 64)))
    for k, c in counts.items():
        size = min(64, total - 64 * k)
        assert sum(c.values()) == size
        for sid, n in slots.items():  # within five standard deviations, in the last shards as in the first
            p = n / total
            assert abs(c.get(sid, 0) - size * p) <= 5 * (size * p * (1 - p)) ** 0.5 + 1
    assert {sid: sum(c.get(sid, 0) for c in counts.values()) for sid in slots} == slots


def test_taken_is_what_the_slots_bring(docs):
    """taken, counted again from the words of each document, the permutations and the slots."""
    config = m.MixConfig(block_words=16, shard_slots=64)
    t = texts(60)
    mix = m.mix(docs(t, sources=list("ab") * 30), config)
    order = {(r.sid, r.place): r.block for r in mix.order.collect()}
    uses = {}
    for r in mix.slots.collect():
        block = r.sid, order[r.sid, r.place]
        uses[block] = uses.get(block, 0) + 1
    sids = {r.source: r.sid for r in mix.sources.collect()}
    begins = {r.row_no: r.first for r in mix.pieces.where("first = 0").collect()}
    want, covered = {}, {}
    for r in mix.pieces.collect():
        want[r.row_no] = want.get(r.row_no, 0) + r.words * uses.get((r.sid, r.block), 0)
        covered.setdefault(r.row_no, []).append((r.first, r.words))
    names = {r.row_no: r for r in mix.rows.collect()}
    for k, parts in covered.items():  # each word of a document lies in exactly one piece
        parts.sort()
        assert begins[k] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) == names[k].size
    got = {r.doc_id: r.taken for r in m.taken(mix).collect()}
    assert got == {r.doc_id: want.get(k, 0) for k, r in names.items()} and set(sids) == {"a", "b"}


def test_reruns_agree_on_other_splits(docs):
    t = texts(60)
    given = docs(t, ids=[None if k % 3 == 0 else k % 7 for k in range(60)], sources=list("ab") * 30)
    results = [sorted((r.doc_id or -1, r.size, r.taken) for r in m.taken(m.mix(d)).collect()) for d in (given, given.repartition(7), given.orderBy("text"))]
    assert results[0] == results[1] == results[2]


def test_query_covers_the_table(spark):
    data = "/root/testdata/sf0.001"
    given = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = m.op2_source_mix(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    sizes, taken = {}, {}
    for r in rows:
        d = given[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and r.taken <= 3 * r.size
        sizes[d.source], taken[d.source] = sizes.get(d.source, 0) + r.size, taken.get(d.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in rows:
        s = given[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    # a source's words come in blocks of 128: its target is met to within a block or two
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 256 for s in sizes)


def test_reruns_agree(docs):
    given = docs(texts(40), sources=list("ab") * 20)
    a, b = (sorted(m.taken(m.mix(given)).collect()) for _ in range(2))
    assert a == b


def test_mixed_documents_hold_what_is_taken(docs):
    t = texts(50)
    given = docs(t, ids=[k // 2 for k in range(50)], sources=list("abcde") * 10, size=["z"] * 50, target=["y"] * 50)
    got = m.mixed_documents(given, m.MixConfig(block_words=16))
    assert got.columns == given.columns
    rows = got.collect()
    total = sum(r.taken for r in m.taken(m.mix(given, m.MixConfig(block_words=16))).collect())
    assert sum(len(r.text.split()) for r in rows) == pytest.approx(total, rel=0.01)
    assert all(r.n_chars == len(r.text) and r.text.split() for r in rows)
    whole = {x.strip() for x in t}
    assert sum(r.text in whole for r in rows) > 10


def test_empty(docs):
    assert m.taken(m.mix(docs([]))).collect() == []
    assert m.mixed_documents(docs([None, ""])).collect() == []
