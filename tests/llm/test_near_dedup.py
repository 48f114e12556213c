import random
import re
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from resonant.llm import near_dedup as n


def words(t):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())


def brute(texts):
    """class and links of each text."""
    nodes = {}
    for k, t in enumerate(texts):
        nodes.setdefault(tuple(words(t)) or k, []).append(k)
    sets = {k: ({k[j : j + 5] for j in range(len(k) - 4)} or {k}) if isinstance(k, tuple) else None for k in nodes}
    links, label = Counter(), {k: min(v) for k, v in nodes.items()}
    pairs = [(a, b) for a, b in combinations([k for k in nodes if sets[k]], 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (label[w], links[w]) for w, ks in nodes.items() for k in ks}


def variants(seed=3):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(40, 200))) for _ in range(25)]
    out = list(base)
    for b in base:
        for _ in range(rng.randrange(5)):
            w = b.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            out.append(" ".join(w))
    out += [base[0].upper(), base[1] + "!", None, "", "...", "one two", "One, two", "one three"]
    rng.shuffle(out)
    return out


def test_against_brute_force(docs):
    texts = variants()
    got = {r.doc_id: (r.class_id, r.n_links) for r in n.classes(docs(texts)).collect()}
    assert got == brute(texts)


def test_large_family_goes_through_blocks(docs):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(70):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.class_id, r.n_links) for r in n.classes(docs(texts), n.ForestConfig(block=16)).collect()}
    assert got == brute(texts)


def test_one_per_class(docs):
    texts = ["a b c d e f g h", "A b, c d e f g h", None, "", "z"]
    given_docs = docs(texts, ids=[5, 5, None, 7, 7], class_id=list("pqrst"), row_no=list("pqrst"))
    got = n.one_per_class(given_docs)
    assert got.columns == given_docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect())[0] == (-1, "")
    assert got.count() == 4
    assert n.classes(docs([])).collect() == []


def near_texts(families, seed=5):
    """Families of texts with a few words replaced, most pairs between 0.75 and 0.97; and each text's links."""
    rng = random.Random(seed)
    texts, links = [], []
    for f in range(families):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        own = []
        for _ in range(5):
            w = list(base)
            for _ in range(max(1, round(len(w) * rng.uniform(0.004, 0.014)))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            own.append(w)
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in own]
        alike = [[a is not b and 0.8 * len(a | b) <= len(a & b) for b in sets] for a in sets]
        texts += [" ".join(w) for w in own]
        links += [sum(x) for x in alike]
    return texts, links


def measured_recall(docs, families):
    texts, want = near_texts(families)
    got = {r.doc_id: r.n_links for r in n.classes(docs(texts)).collect()}
    assert all(got[k] <= w for k, w in enumerate(want))
    return sum(got.values()) / sum(want), sum(want) // 2


def test_recall_near_the_threshold(docs):
    recall, pairs = measured_recall(docs, 400)
    assert pairs > 1000 and recall >= 0.99


def test_prefixes_are_shortened_as_the_pairs_ask(docs):
    # only pairs far above the threshold: the longest prefix finds them all
    rng = random.Random(2)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "z"]) for b in base]
    assert n.join(docs(texts)).prefix == n.ForestConfig().depth
    # pairs near the threshold, or too few to tell: shorter ones
    assert n.ForestConfig().shortest <= n.join(docs(near_texts(100)[0])).prefix < n.ForestConfig().depth
    assert n.join(docs(["a b c d e f g", "a b c d e f h"])).prefix == n.ForestConfig().shortest


def test_estimated_recall():
    c = n.ForestConfig()
    rng = random.Random(4)
    met, found, pairs = Counter(), 0, 20_000
    for _ in range(pairs):
        s = round(rng.uniform(0.8, 0.9) * c.hashes)
        trees = sum(rng.random() < (s / c.hashes) ** 8 for _ in range(c.trees))
        met[s] += trees
        found += trees > 0
    assert abs(n.estimated_recall(met, 8, c) - found / pairs) < 0.002
    assert n.estimated_recall({180: 10}, 8, c) == 0


def test_large_families_with_a_core(docs):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(1 if k % 3 else 6):
            w[rng.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:150] + [f"u{k}{j}" for j in range(250)]) for k in range(40)]  # a passage shared, no link
    got = {r.doc_id: (r.class_id, r.n_links) for r in n.classes(docs(texts), n.ForestConfig(block=8)).collect()}
    assert got == brute(texts)


def test_a_large_family_is_taken_up_once(docs, monkeypatch):
    """Shorter prefixes leave out the pairs that are in one family already, and so nearly all rows of a large one."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    rows, write = Counter(), n.written

    def counted(df, label):
        out = write(df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(n, "written", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in n.classes(docs(texts), n.ForestConfig(block=16, enough=10**9)).collect()}
    assert got == brute(texts)
    # a row for each node and tree at most; each prefix had nearly as many
    assert rows["near-members"] <= n.ForestConfig().trees * len(texts)


def test_null_and_repeated_ids(docs):
    texts = variants(9)
    ids = [None if k % 3 == 0 else k % 7 for k in range(len(texts))]
    got = n.classes(docs(texts, ids=ids)).collect()
    want = brute(texts)
    assert len(got) == len(texts)
    assert Counter(r.n_links for r in got) == Counter(v[1] for v in want.values())
    assert sum(r.kept for r in got) == len({v[0] for v in want.values()})


def test_query_covers_the_table(spark):
    data = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in n.op7_near_duplicates(spark, data).collect()}
    want = brute([t for _, t in given])
    assert {i: (got[i].class_id, got[i].n_links) for i, _ in given} == {given[k][0]: (given[c][0], m) for k, (c, m) in want.items()}


def test_shortest_prefix_meets_the_target():
    c = n.ForestConfig()
    at = lambda k: 1 - (1 - 0.8**k) ** c.trees
    assert at(c.shortest) >= c.target_recall > at(c.shortest + 1)
    assert n.ForestConfig(target_recall=0.9).shortest > c.shortest


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words_are_hashed_by_content(t):
    h = n.word_hashes(t)
    assert len(h) == len(words(t))
    assert len(set(h.tolist())) == len(set(words(t)))


def test_very_long_text():
    assert len(n.shingles(n.word_hashes(" ".join(f"w{k}" for k in range(60_000))), 5)) == 59_996
