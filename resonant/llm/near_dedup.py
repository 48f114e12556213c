"""N-gram Jaccard join with a MinHash LSH forest.

A document's shingles are the runs of five words of its whole text; a text with
fewer words is one shingle. The links are the pairs of different texts whose
shingle sets have a Jaccard similarity of at least 0.8.

1. Texts with the same words are one node. A node's signature holds `depth` minhashes
   for each tree; these are its label in the tree.
2. Each tree is a prefix trie: its labels, sorted. The longest prefix that a label
   shares with a neighbour in this order is the longest that it shares with any.
3. The first subtries are those of equal labels. Their nodes are compared by
   signature, leaving a wide margin under the threshold, and the matched prefix is
   then shortened: only subtries that join shorter ones are compared anew, and only
   pairs that were apart and are in no family together yet. From the similarities of
   the pairs compared so far and the chance that a tree brings such a pair together,
   the share of pairs found is estimated (at shorter prefixes rather too low, as pairs
   inside a family are found without a meeting); shortening ends when it reaches the
   target, at the latest at the prefix at which pairs just at the threshold are found
   with the target probability.
4. Nodes that are alike join families. In each family the shingle sets are compared
   exactly. Only link counts and a spanning forest leave a group, never its pairs.
5. Classes are the connected components of the links.

Large subtries and families. Each is first compared with one of its nodes, the leader:
the one whose subtries of equal labels are the largest, as most are like it.
In a subtrie, nodes like the leader or of its family are connected through it. In a family, Jaccard
distance is a metric: nodes within half the largest distance of the leader are linked
with each other, and are counted without being compared. The others are compared with
all, in blocks; each pair of blocks is a group of its own, so no group is large.

Defined cases
    null, empty text, no words    no link; each is a class of its own
    null doc_id                   compared like others; class_id comes from the
                                  class's smallest doc_id, null if it has none
    repeated rows, repeated ids   equal texts are copies, whatever their doc_id; rows
                                  are told apart by a number of their own
    very long texts               all shingles count; a text is shingled in one task
    ties                          pairs at the threshold exactly are linked; of rows
                                  with the class's smallest doc_id the first is kept
    empty table                   empty result
    extra columns                 not read by `classes`, kept by `one_per_class`
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.components import Forest, components
from resonant.llm.runs import binary_matrix, whole_groups
from resonant.llm.shared import documents, written
from resonant.session import ship


@dataclass(frozen=True)
class ForestConfig:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    depth: int = 8  # minhashes of a label, one byte each
    target_recall: float = 0.999
    enough: int = 200  # meetings of similar pairs from which the recall is estimated
    margin: float = 4.0  # standard errors of the signature's estimate under the threshold
    block: int = 64
    seed: int = 7

    @property
    def shortest(self) -> int:
        """The longest prefix at which a pair at the threshold is met with the target probability."""
        length = self.depth
        while length > 1 and 1 - (1 - self.threshold**length) ** self.trees < self.target_recall:
            length -= 1
        return length

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    @property
    def least_equal(self) -> float:
        """The share of equal minhashes from which two nodes join a family."""
        t = self.threshold
        return t - self.margin * math.sqrt(t * (1 - t) / self.hashes)


def estimated_recall(meetings: dict[int, int], prefix: int, config: ForestConfig) -> float:
    """The share of similar pairs that meet in some tree at this prefix, by those that did.

    meetings counts, by equal minhashes, the meetings of a pair in a tree. A pair of
    similarity s meets in a tree with probability s^prefix, so each meeting stands
    for 1 / (trees * s^prefix) pairs, of which (1 - s^prefix)^trees meet nowhere.
    0 while there are too few meetings to tell.
    """
    if sum(meetings.values()) < config.enough:
        return 0.0
    pairs = lost = 0.0
    for equal, n in meetings.items():
        p = (equal / config.hashes) ** prefix
        pairs += n / (config.trees * p)
        lost += n / (config.trees * p) * (1 - p) ** config.trees
    return 1 - lost / pairs


# --- texts to words, shingles and signatures -------------------------------------------------

_BASE, _ODD = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """ASCII letters, digits and underscore, and every byte of other characters."""
    return np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_ODD)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], _word_bytes()[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of runs of n words, sorted."""
    n = min(n, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def fingerprint(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=2)
def _families(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(grams: np.ndarray, config: ForestConfig) -> np.ndarray:
    """A byte of the smallest value of each hash function over the shingles, tree after tree."""
    a, b = _families(config.hashes, config.seed)
    folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.full(config.hashes, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(folded), 1024):
        part = folded[lo : lo + 1024]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)  # smallest values have few bits of their own


# --- groups: pairs are compared inside, forests come out -------------------------------------


def forest_edges(pairs: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs over rows 0..n-1, each row to the least of its tree."""
    a, b = pairs
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def similar_rows(sig: np.ndarray, first: np.ndarray, second: np.ndarray, config: ForestConfig, labels: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row of first and one of second (all pairs if they are the same) with like signatures, and their equal minhashes.

    labels tell which pairs to compare: those that differ in each.
    """
    need = config.least_equal * config.hashes
    out_a, out_b, out_n = [], [], []
    for i, x in enumerate(first):
        others = second[i + 1 :] if first is second else second
        for label in labels:
            others = others[label[others] != label[x]]
        if len(others):
            equal = (sig[others] == sig[x]).sum(axis=1)
            hit = equal >= need
            out_a.append(np.full(hit.sum(), x))
            out_b.append(others[hit])
            out_n.append(equal[hit])
    if not out_a:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repetitions."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / max(1, len(a) + len(b) - common)


def linked_rows(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as above whose sets have at least the threshold as Jaccard similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    common = np.zeros((len(first), len(second)), np.float32)
    at = np.full(len(sets), -1)
    at[first] = np.arange(len(first))
    to = np.full(len(sets), -1)
    to[second] = np.arange(len(second))
    width = 4096
    for lo in range(0, len(grams), width):
        i, j = np.searchsorted(ids, [lo, lo + width])
        r, c = row[i:j], ids[i:j] - lo
        x = np.zeros((len(first), width), np.float32)
        f = at[r] >= 0
        x[at[r[f]], c[f]] = 1
        if first is second:
            common += x @ x.T
        else:
            y = np.zeros((len(second), width), np.float32)
            s = to[r] >= 0
            y[to[r[s]], c[s]] = 1
            common += x @ y.T
    union = sizes[first][:, None] + sizes[second][None, :] - common
    a, b = np.nonzero(common >= threshold * union - 1e-6)
    if first is second:
        a, b = a[a < b], b[a < b]
    return first[a], second[b]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, rows, first, second) for batches sorted by (key, block, other block), with the row's own block.

    Columns: key, lower block, upper block, own block, node, ...
    """
    for batch, starts in whole_groups(batches, 3):
        own, node = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        low, high = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for i, j in zip(starts[:-1], starts[1:]):
            _, keep = np.unique(node[i:j], return_index=True)
            rows = i + keep
            if len(rows) < 2:
                continue
            if low[i] == high[i]:
                first = second = np.arange(len(rows))
            else:
                first, second = np.flatnonzero(own[rows] == low[i]), np.flatnonzero(own[rows] == high[i])
            yield batch, rows, first, second


def blocked(members: DataFrame, config: ForestConfig) -> DataFrame:
    """members(key, node, core, n_core, n_rest, ...) with a row for each pair of blocks of its key that it is in.

    Rows outside the core meet all rows of their key, rows of the core do not meet each other.
    """
    rest, core = (F.ceil(F.col(n) / config.block) for n in ("n_rest", "n_core"))
    place = F.xxhash64(F.lit(config.seed), "node")
    own = F.when(F.col("core"), rest + F.pmod(place, F.greatest(core, F.lit(1)))).otherwise(F.pmod(place, F.greatest(rest, F.lit(1))))
    last = F.when(F.col("core"), rest - 1).otherwise(rest + core - 1)
    out = members.where("n_rest > 0").withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumn("__low", F.least("__own", "__other")).withColumn("__high", F.greatest("__own", "__other"))


def _dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    keys = ["key", "__low", "__high"]
    return df.select(*keys, "__own", "node", *columns).repartition(*keys).sortWithinPartitions(*keys)


# --- the forest ------------------------------------------------------------------------------


def forest(signed: DataFrame, config: ForestConfig) -> DataFrame:
    """tree, label, node, matched: the sorted tries of signed(node, sig), without labels that share too short a prefix.

    matched is the longest prefix shared with a neighbour. Each task holds a stretch of
    a trie; the rows at its ends, whose neighbours it does not see, count as fully matched.
    """
    label = F.expr(f"substring(sig, tree * {config.depth} + 1, {config.depth})")
    rows = signed.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(config.trees - 1))).alias("tree")).select("tree", label.alias("label"), "node")
    dealt = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    depth, shortest = config.depth, config.shortest

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, np.ndarray, np.ndarray] | None = None  # the last batch, its rows as bytes, shared prefixes with the row before

        def out(batch: pa.RecordBatch, before: np.ndarray, after: int) -> pa.RecordBatch:
            matched = np.maximum(before, np.append(before[1:], after)).astype(np.int32)
            keep = pa.array(matched >= shortest)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(matched)], names=["tree", "label", "node", "matched"]).filter(keep)

        for batch in batches:
            if not len(batch):
                continue
            labels = np.concatenate([batch.column(0).to_numpy().astype(np.uint8)[:, None], binary_matrix(batch.column(1), "u1", depth)], axis=1)
            line = labels if held is None else np.concatenate([held[1][-1:], labels])
            same = np.cumprod(line[1:] == line[:-1], axis=1).sum(axis=1) - 1  # the tree's number comes first
            before = np.maximum(same, 0)
            if held is None:
                before = np.append(depth, before)
            else:
                yield out(held[0], held[2], before[0])
            held = (batch, labels, before)
        if held is not None:
            yield out(held[0], held[2], depth)

    return dealt.mapInArrow(shared, "tree int, label binary, node long, matched int")


def _coreless(members: DataFrame) -> DataFrame:
    return members.withColumns({"core": F.lit(False), "n_core": F.lit(0).cast("long"), "n_rest": F.col("size")})


def _with_core(members: DataFrame) -> DataFrame:
    """members(key, node, size, core, ...) of a written table with n_core and n_rest of their key."""
    # both sides of a join by key are plain tables, so that a large key can be split
    counts = written(members.groupBy("key").agg(F.count_if("core").alias("n_core")), "near-core-sizes")
    return members.hint("merge").join(counts, "key").withColumn("n_rest", F.col("size") - F.col("n_core"))


def _compare(tries: DataFrame, signed: DataFrame, families: DataFrame | None, prefix: int, config: ForestConfig) -> tuple[DataFrame, DataFrame] | None:
    """a, b: edges between nodes that are alike, meet first at this prefix and are in no family together; rows with a < 0 count meetings.

    And key, size, node, ...: the subtries. families(node, component, central) are those of the longer prefixes.
    """
    at = lambda n: F.xxhash64("tree", F.expr(f"substring(label, 1, {n})"))
    full = prefix == config.depth
    keyed = tries.where(F.col("matched") >= prefix).select(at(prefix).alias("key"), (F.lit(0).cast("long") if full else at(prefix + 1)).alias("child"), "node")
    if families is None:
        keyed = keyed.withColumns({"family": F.col("node"), "central": F.lit(0).cast("long")})
    else:
        keyed = keyed.join(families.withColumnRenamed("component", "family"), "node", "left")
        keyed = written(keyed.select("key", "child", "node", F.coalesce("family", "node").alias("family"), F.coalesce("central", F.lit(0)).alias("central")), "near-keyed")
    differ = lambda c: F.min(c) != F.max(c)
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("central", "node", "family")).alias("head"), (differ("family") & (F.lit(full) | differ("child"))).alias("joins"))
    groups = written(groups.where("joins").select("key", "size", F.col("head.node").alias("leader"), F.col("head.family").alias("its_family")), "near-subtries")
    largest = groups.agg(F.max("size")).first()[0]
    if not largest:
        return None
    columns = ["key", "size", "child", "node", "sig", "family"]
    if largest <= config.block:
        members = keyed.hint("merge").join(groups, "key").join(signed, "node").select(*columns)
        met, edges = written(members, "near-members"), None
        members = _coreless(met)
    else:
        # the nodes of large subtries compare with one of them
        first = signed.select(F.col("node").alias("leader"), F.col("sig").alias("first"))
        led = groups.where(F.col("size") > config.block).join(first, "leader")
        led = written(led.unionByName(groups.where(F.col("size") <= config.block), allowMissingColumns=True), "near-led")
        need = config.least_equal * config.hashes

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                core = batch.column(5).to_numpy() == batch.column(7).to_numpy()
                large = batch.column(8).is_valid()
                rows, large = batch.filter(large), large.to_numpy(zero_copy_only=False)
                core &= large
                if len(rows):
                    core[large] |= (binary_matrix(rows.column(4), "u1", config.hashes) == binary_matrix(rows.column(8), "u1", config.hashes)).sum(axis=1) >= need
                yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(core)], names=[*columns, "leader", "its_family", "core"])

        members = keyed.hint("merge").join(led, "key").join(signed, "node").select(*columns, "leader", "its_family", "first")
        met = written(members.mapInArrow(near, "key long, size long, child long, node long, sig binary, family long, leader long, its_family long, core boolean"), "near-members")
        edges = met.where("core AND family <> its_family").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        members = _coreless(met.where(F.col("size") <= config.block)).unionByName(_with_core(met.where(F.col("size") > config.block)))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        meetings = np.zeros(config.hashes + 1, np.int64)
        least = config.threshold * config.hashes
        for batch, rows_, first, second in _groups(batches):
            taken = pa.array(rows_)
            sig = binary_matrix(batch.column(6).take(taken), "u1", config.hashes)
            child, family = (batch.column(k).to_numpy()[rows_] for k in (5, 7))
            a, b, equal = similar_rows(sig, first, second, config, () if full else (child, family))
            np.add.at(meetings, equal[equal >= least], 1)
            a, b = forest_edges((a, b), len(rows_))
            node = batch.column(4).to_numpy()[rows_]
            new = [e for e in zip(node[b].tolist(), node[a].tolist()) if known.joins(*e)]
            if new:
                x, y = zip(*new)
                yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})
        met = np.flatnonzero(meetings)
        yield pa.RecordBatch.from_pydict({"a": pa.array(-met - 1, pa.int64()), "b": pa.array(meetings[met])})

    found = _dealt(blocked(members, config), ["child", "sig", "family"]).mapInArrow(alike, "a long, b long")
    found = written(found, "near-alike")
    return (found if edges is None else found.unionByName(edges)), met


# --- the join --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    rows: DataFrame  # doc_id, row_no, fp (null without words)
    nodes: DataFrame  # fp, node, least_id, copies
    links: DataFrame  # node, n_links: nodes with links only
    classes: DataFrame  # node, component: nodes with links only
    prefix: int  # the shortest matched prefix


def join(docs: DataFrame, config: ForestConfig = ForestConfig(), key: str | None = None) -> Join:
    """Nodes, links and classes of all documents; see the module's text.

    key names a column of a written table that tells its rows apart; without it the
    rows are numbered and written here, so that a text can be fetched again.
    """
    ship(docs.sparkSession)
    if key:
        texts = docs.select("doc_id", F.col(key).alias("row_no"), "text")
    else:
        texts = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), "text"), "near-texts")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                fps, sigs = [], []
                for t in part.column(2):
                    words = word_hashes(t.as_py() or "")
                    fps.append(fingerprint(words) if len(words) else None)
                    sigs.append(signature(shingles(words, config.words), config).tobytes() if len(words) else None)
                arrays = [*part.columns[:2], pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_no", "fp", "sig"])

    rows = written(texts.mapInArrow(sign, "doc_id long, row_no long, fp binary, sig binary"), "near-rows")
    nodes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = written(nodes, "near-nodes")
    signed = written(rows.select(F.col("row_no").alias("node"), "sig").join(nodes.select("node"), "node"), "near-signed")

    # the matched prefix is shortened until the pairs that were found let expect the target recall
    tries = written(forest(signed, config), "near-tries")
    no_edges = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    families = central = None
    meetings, prefix = {}, config.depth + 1

    def joined(edges: DataFrame) -> DataFrame:
        if families is not None:
            edges = edges.unionByName(families.select(F.col("node").alias("a"), F.col("component").alias("b")))
        sizes = central if central is not None else no_edges.select(F.col("a").alias("node"), F.col("b").alias("central"))
        return written(components(edges).join(sizes, "node", "left").withColumn("central", F.coalesce("central", F.lit(0).cast("long"))), "near-joined")

    while prefix > config.shortest and estimated_recall(meetings, prefix, config) < config.target_recall:
        prefix -= 1
        found = _compare(tries, signed, families, prefix, config)
        if found is not None:
            edges, members = found[0].where("a >= 0"), found[1]
            if prefix == config.depth:
                central = written(members.groupBy("node").agg(F.sum("size").alias("central")), "near-central")
            if families is None or not edges.isEmpty():
                families = joined(edges)
            # at most one row for each number of equal minhashes
            for r in found[0].where("a < 0").groupBy("a").agg(F.sum("b").alias("n")).collect():
                meetings[-r["a"] - 1] = meetings.get(-r["a"] - 1, 0) + r["n"]
    families = joined(no_edges) if families is None else families
    sized = families.groupBy(F.col("component").alias("key")).agg(F.count("*").alias("size"), F.max(F.struct("central", "node")).alias("head"))
    sized = written(sized.select("key", "size", F.col("head.node").alias("leader")), "near-sizes")
    families = written(families.select(F.col("component").alias("key"), "node").hint("merge").join(sized, "key"), "near-families")

    # the shingle sets of those nodes, from their texts
    found = texts.select(F.col("row_no").alias("node"), "text").hint("merge").join(families, "node").select("key", "node", "size", "leader", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sets = [shingles(word_hashes(t.as_py() or ""), config.words).tobytes() for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], names=["key", "node", "size", "leader", "grams"])

    sets = written(found.mapInArrow(shingled, "key long, node long, size long, leader long, grams binary"), "near-sets")

    # in large families, the nodes so close to the family's leader that they are all linked with each other
    close = 1 - (1 - config.threshold) / 2

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= close for a, b in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near, pa.bool_())], names=["key", "node", "size", "leader", "grams", "core"])

    members, more = _coreless(sets.where(F.col("size") <= config.block)), None
    if (sized.agg(F.max("size")).first()[0] or 0) > config.block:
        large = sets.where(F.col("size") > config.block)
        leaders = large.where("node = leader").select("key", F.col("grams").alias("__first"))
        both = large.hint("merge").join(leaders, "key").select("key", "node", "size", "leader", "grams", "__first")
        large = _with_core(written(both.mapInArrow(measured, "key long, node long, size long, leader long, grams binary, core boolean"), "near-core"))
        more = written(large.where("core AND n_core > 1").select(F.col("node").alias("a"), F.col("leader").alias("b"), (F.col("n_core") - 1).alias("links")), "near-core-links")
        members = members.unionByName(large)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows_, first, second in _groups(batches):
            grams = [np.frombuffer(g.as_py(), np.uint64) for g in batch.column(5).take(pa.array(rows_))]
            if not len(first) or not len(second):
                continue
            a, b = linked_rows(grams, first, second, config.threshold)
            n = np.bincount(a, minlength=len(rows_)) + np.bincount(b, minlength=len(rows_))
            to = np.arange(len(rows_))
            child, parent = forest_edges((a, b), len(rows_))
            to[child] = parent
            some = np.flatnonzero(n)
            node = batch.column(4).to_numpy()[rows_]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[to[some]]), pa.array(n[some].astype(np.int64))], names=["a", "b", "links"])

    compared = _dealt(blocked(members, config), ["grams"]).mapInArrow(linked, "a long, b long, links long")
    found_links = written(compared, "near-links")
    if more is not None:
        found_links = found_links.unionByName(more)
    links = found_links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    return Join(rows.select("doc_id", "row_no", "fp"), nodes, links, components(found_links.select("a", "b")), prefix)


def classes(docs: DataFrame, config: ForestConfig = ForestConfig(), key: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copies, kept, row_no.

    class_id is the smallest doc_id of the class, n_links the number of different
    texts that the document's text is linked to, copies the rows with its words.
    kept marks one row of each class, the one with the smallest doc_id.
    """
    j = join(docs, config, key)
    nodes = j.nodes.join(j.links, "node", "left").join(j.classes, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    # both sides of a join by component or family are plain tables, so that a large one can be split
    nodes = written(nodes, "near-nodes")
    named = written(nodes.groupBy("component").agg(F.min("least_id").alias("class_id")), "near-names")
    nodes = written(nodes.hint("merge").join(named, "component"), "near-classes").select("fp", "component", "class_id", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = written(j.rows.hint("merge").join(nodes, "fp", "left"), "near-result")
    # one row of a class stays: its smallest doc_id, of repeated ones the first
    stays = rows.where("component IS NOT NULL AND doc_id <=> class_id").groupBy("component").agg(F.min("row_no").alias("__stays"))
    stays = stays.select(F.col("__stays").alias("row_no"), F.lit(True).alias("__kept"))
    out = rows.join(stays, "row_no", "left")
    return out.select(
        "doc_id",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        (F.col("component").isNull() | F.coalesce("__kept", F.lit(False))).alias("kept"),
        "row_no",
    )


def one_per_class(docs: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """The documents that stay, the first row of each class, with all their columns."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    fields = docs.schema["__row"].dataType.names
    # rows are numbered, so that repeated and null doc_ids are told apart
    docs = written(docs.withColumn("__key", F.monotonically_increasing_id()), "near-docs")
    flat = docs.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text"))
    decided = classes(flat, config, key="doc_id")
    gone = decided.where("NOT kept").select(F.col("doc_id").alias("__key"))
    return docs.join(gone, "__key", "left_anti").select(*[F.col(f"__row.`{c}`").alias(c) for c in fields])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).drop("row_no")
