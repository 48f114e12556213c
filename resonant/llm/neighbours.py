"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Index. Vectors that are identical are one node. An edge leads to a node with a large
inner product, whatever the lengths; for the graph, components are stored as bytes,
so that what moves between machines is small. A few orders by the signs of random
hyperplanes give each node some first neighbours out of short windows, a fixed number
of comparisons whatever the table's size. NN-descent then joins the edges of the graph
with themselves: the neighbours, and sampled reverse neighbours, of each node are
compared with each other, each offers its best to the others, and each keeps its best.
Rounds go on until few edges change.

Search. A query starts at its own node, looks at the neighbours of its best nodes
that it has not looked at, and ends when its best `beam` nodes hold no such node.
The best are then measured in double precision on the original vectors.

What a node keeps, offers and samples bounds the work per vector and round, whatever
the table's size or its distribution: the result is approximate, and recall is
measured in the tests against brute force. All rows are indexed.

Defined cases
    null, empty or zero vectors, null or non-finite components    take no part
    vectors of different numbers of components                    are not compared: each number has an index of its own
    very long vectors                                             held whole, a window of them in one task
    null vec_id                                                   a candidate, after all others in ties; no query
    repeated vec_ids                                              each row is a candidate of its own
    identical vectors                                             found together, ties to smaller vec_id
    fewer candidates than asked for                               all that are reached
    empty table                                                   empty result
    extra columns, also of the index's own names                  not read
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.llm.runs import binary_matrix, whole_groups
from resonant.llm.shared import discard, written
from resonant.session import ship


@dataclass(frozen=True)
class NeighbourConfig:
    degree: int = 56  # neighbours of a node in the graph
    reverse: int = 16  # reverse neighbours that a comparison takes, on average
    offers: int = 5  # nodes that a comparison offers to each of its nodes
    orders: int = 6  # hyperplane orders for the first neighbours
    window: int = 32  # vectors compared in a window of such an order
    window_best: int = 10
    settled: float = 0.04  # share of new edges at which the rounds end
    beam: int = 48
    reach: int = 28  # neighbours that the search looks at from a node
    seed: int = 3


def usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, embedding, width of the vectors that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(e.isNotNull() & (F.size(e) > 0)).where(finite).where(F.exists(e, lambda x: x != 0))
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding", F.size("embedding").alias("width")), "ann-rows")


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


# --- numbers ---------------------------------------------------------------------------------


def as_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as signed bytes with a scale."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def best_of(node: np.ndarray, near: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(node, near, sim) without repetitions, the `most` largest sims of each node, largest first."""
    order = np.lexsort((-sim, near, node))
    node, near, sim = node[order], near[order], sim[order]
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    keep &= node != near
    node, near, sim = node[keep], near[keep], sim[keep]
    order = np.lexsort((near, -sim, node))
    node, near, sim = node[order], near[order], sim[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, int)
    place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = place < most
    return node[keep], near[keep], sim[keep]


class Best:
    """Gathers (node, near, sim) and keeps the `most` best of each node; memory follows the nodes."""

    def __init__(self, most: int, pause: int = 1_500_000):
        self.most, self.pause, self.held, self.parts = most, pause, 0, []

    def add(self, node: np.ndarray, near: np.ndarray, sim: np.ndarray) -> None:
        self.parts.append((node, near, sim))
        self.held += len(node)
        if self.held > self.pause:
            self.parts = [self.now()]
            self.held = len(self.parts[0][0])
            self.pause = max(self.pause, 2 * self.held)

    def now(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        return best_of(*(np.concatenate(x) for x in zip(*self.parts)), self.most)

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield from neighbour_rows(*self.now())


def neighbour_rows(node: np.ndarray, near: np.ndarray, sim: np.ndarray, fresh: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row per node: node, near, sim[, fresh] as arrays."""
    if not len(node):
        return
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ends = pa.array(np.append(first, len(node)), pa.int32())
    columns = {"node": pa.array(node[first])}
    for name, values in (("near", near), ("sim", sim.astype(np.float32)), ("fresh", fresh)):
        if values is not None:
            columns[name] = pa.ListArray.from_arrays(ends, pa.array(values))
    whole = pa.RecordBatch.from_pydict(columns)
    for lo in range(0, len(whole), 4096):
        yield whole.slice(lo, 4096)


def _lists(batch: pa.RecordBatch, *columns: int) -> tuple[np.ndarray, ...]:
    """Row numbers and the flat values of list columns of equal lengths."""
    sizes = np.diff(batch.column(columns[0]).offsets.to_numpy())
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns]
    return np.repeat(np.arange(len(batch)), sizes), *flat


# --- the graph -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Graph:
    rows: DataFrame  # uid, vec_id, embedding, node
    nodes: DataFrame  # node, bytes, scale
    near: DataFrame  # node, near, sim: best first
    width: int


def build(vectors: DataFrame, config: NeighbourConfig = NeighbourConfig()) -> Graph:
    """The neighbour graph of vectors with the same number of components."""
    return _graph(usable(vectors), config)


def _graph(rows: DataFrame, config: NeighbourConfig) -> Graph:
    spark = ship(rows.sparkSession)
    widths = rows.agg(F.min("width"), F.max("width")).first()
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} components: use nearest()")
    rows = rows.drop("width")
    same = [F.xxhash64("embedding").alias("__k1"), F.xxhash64(F.reverse("embedding"), F.lit(config.seed)).alias("__k2")]
    keyed = rows.select("uid", *same)
    groups = keyed.groupBy("__k1", "__k2").agg(F.min("uid").alias("node"))
    named = keyed.hint("merge").join(groups, ["__k1", "__k2"]).select("uid", "node")
    rows = written(rows.hint("merge").join(named, "uid"), "ann-named")
    single = rows.where("uid = node")
    n, width = single.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                q, scale = as_bytes(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale)], names=["node", "bytes", "scale"])

    nodes = written(single.select("node", "embedding").mapInArrow(shrink, "node long, bytes binary, scale float"), "ann-nodes")
    near = written(_first_neighbours(nodes, n, width, config), "ann-near")
    for turn in itertools.count():
        better = _descend(nodes, near, turn, width, config)
        merged = written(_merge(near, better, config.degree), "ann-near")
        discard(near)
        near = merged
        fresh, edges = near.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("near"))).first()
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the finished round's shuffle files
        if not edges or fresh <= config.settled * edges:
            break
    return Graph(rows, nodes, near, width)


def _first_neighbours(nodes: DataFrame, n: int, width: int, config: NeighbourConfig) -> DataFrame:
    bits = min(40, max(1, math.ceil(math.log2(max(2, n)))))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(config.seed).normal(size=(config.orders, width, bits)).astype(np.float32)
        powers = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            x = binary_matrix(batch.column(1), "i1", width).astype(np.float32) if len(batch) else np.empty((0, width), np.float32)
            for k in range(config.orders):
                code = ((x @ planes[k]) > 0) @ powers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), k, np.int64)), pa.array(code), *batch.columns], names=["turn", "code", "node", "bytes", "scale"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(config.degree)
        for batch, starts in whole_groups(batches, 1):
            node = batch.column(2).to_numpy()
            x = binary_matrix(batch.column(3), "i1", width).astype(np.float32) * batch.column(4).to_numpy()[:, None]
            for i, j in zip(starts[:-1], starts[1:]):
                pieces = max(1, round((j - i) / config.window))
                cuts = np.linspace(i, j, pieces + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b - a < 2:
                        continue
                    sim = x[a:b] @ x[a:b].T
                    np.fill_diagonal(sim, -np.inf)
                    most = min(config.window_best, b - a - 1)
                    top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                    best.add(np.repeat(node[a:b], most), node[a:b][top].ravel(), np.take_along_axis(sim, top, axis=1).ravel())
        yield from best.batches()

    # a range partition holds a stretch of an order; windows of one order stay in it
    stretch = max(1, -(-n * config.orders // 100_000))
    dealt = nodes.mapInArrow(orders, "turn long, code long, node long, bytes binary, scale float")
    tasks = max(stretch, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(tasks, "turn", "code", "node").sortWithinPartitions("turn", "code", "node")
    found = dealt.mapInArrow(windows, "node long, near array<long>, sim array<float>")
    start = nodes.select("node", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("sim"), F.array().cast("array<boolean>").alias("fresh"))
    return _merge(start, found, config.degree)


def _merge(near: DataFrame, better: DataFrame, degree: int) -> DataFrame:
    """near with the best of its own and better's neighbours; fresh marks those it did not have."""
    old = near.select("node", "near", "sim", F.lit(True).alias("old"))
    rows = old.unionByName(better.withColumn("old", F.lit(False))).repartition("node").sortWithinPartitions("node")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in whole_groups(batches, 1):
            row, to, sim = _lists(batch, 1, 2)
            own = batch.column(0).to_numpy()
            node = own[row]
            was = batch.column(3).to_numpy(zero_copy_only=False)[row]
            had = np.stack([node[was], to[was]], axis=1)
            a, b, s = best_of(node, to, sim, degree)
            both = np.concatenate([had, np.stack([a, b], axis=1)])
            _, inverse = np.unique(both, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            fresh = ~np.isin(inverse[len(had) :], inverse[: len(had)])
            yield from neighbour_rows(a, b, s, fresh)
            lonely = np.setdiff1d(own, a)
            if len(lonely):
                none = pa.ListArray.from_arrays
                ends = pa.array(np.zeros(len(lonely) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(lonely), none(ends, pa.array([], pa.int64())), none(ends, pa.array([], pa.float32())), none(ends, pa.array([], pa.bool_()))], names=["node", "near", "sim", "fresh"])

    return rows.mapInArrow(merge, "node long, near array<long>, sim array<float>, fresh array<boolean>")


def _descend(nodes: DataFrame, near: DataFrame, turn: int, width: int, config: NeighbourConfig) -> DataFrame:
    """One round: what the neighbours of each node find among each other."""
    # joins by a node that is near to many have plain tables on both sides, so that such a node can be split
    edges = near.select(F.col("node").alias("a"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("a", F.col("e.near").alias("b"), F.col("e.fresh").alias("fresh"))
    degrees = written(edges.groupBy("b").agg(F.count("*").alias("n")), "ann-degrees")
    draw = F.pmod(F.xxhash64(F.lit(config.seed + turn), "a", "b"), F.col("n")) < config.reverse
    back = edges.join(degrees, "b").where(draw).select(F.col("b").alias("pivot"), F.col("a").alias("node"), "fresh")
    members = edges.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "fresh").unionByName(back)
    last = near.select("node", F.when(F.size("near") >= config.degree, F.array_min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    known = written(nodes.join(last, "node"), "ann-known")
    dealt = members.join(known, "node").select("pivot", "node", "fresh", "bytes", "scale", "worst").repartition("pivot").sortWithinPartitions("pivot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node of a pivot's gets the best of the others that would be new to it, if the pair has a fresh edge."""
        best = Best(config.degree)
        for batch, starts in whole_groups(batches, 1):
            node, fresh = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x = binary_matrix(batch.column(3), "i1", width).astype(np.float32) * batch.column(4).to_numpy()[:, None]
            worst = batch.column(5).to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for i, j in zip(starts[:-1], starts[1:]):
                new = fresh[i:j]
                if not new.any():
                    continue
                sim = x[i:j] @ x[i:j].T
                sim[(sim <= worst[i:j, None]) | ~(new[:, None] | new[None, :]) | (node[i:j, None] == node[None, i:j])] = -np.inf
                most = min(config.offers, j - i)
                top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                a, b = np.repeat(np.arange(j - i), most), top.ravel()
                some = sim[a, b] > -np.inf
                a, b = a[some], b[some]
                found.append((node[i + a], node[i + b], sim[a, b]))
            if found:
                best.add(*(np.concatenate(f) for f in zip(*found)))
        yield from best.batches()

    return dealt.mapInArrow(compare, "node long, near array<long>, sim array<float>")


# --- the search ------------------------------------------------------------------------------


def search(graph: Graph, wanted: Column, k: int = 20, config: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of the index that `wanted` selects."""
    spark = graph.rows.sparkSession
    width = graph.width
    queries = graph.rows.where(wanted).select(F.col("uid").alias("q_uid"), F.col("vec_id").alias("query_id"), "node", F.col("embedding").alias("q_embedding"))
    start = queries.select("node").distinct().join(graph.nodes, "node")
    pool = written(start.select(F.col("node").alias("q"), F.lit(0).alias("kind"), "bytes", "scale", F.array("node").alias("ids"), F.array(F.lit(float("inf")).cast("float")).alias("sims"), F.array(F.lit(False)).alias("seen")), "ann-pool")
    steps = graph.near.select(F.col("node").alias("id"), F.slice("near", 1, config.reach).alias("next"))
    schema = "q long, kind int, bytes binary, scale float, ids array<long>, sims array<float>, seen array<boolean>"

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, 1):
            x = binary_matrix(batch.column(2), "i1", width).astype(np.float32) * batch.column(3).to_numpy()[:, None]
            kind, lists = batch.column(1).to_numpy(), batch.column(4)
            out: dict[str, list] = {"row": [], "ids": [], "sims": [], "seen": []}
            for i, j in zip(starts[:-1], starts[1:]):
                own = i + int(np.argmin(kind[i:j]))
                others = np.delete(np.arange(i, j), own - i)
                ids = np.asarray(lists[own].as_py(), np.int64)
                sims = np.asarray(batch.column(5)[own].as_py(), np.float32)
                if len(others):
                    found = np.fromiter((lists[int(o)][0].as_py() for o in others), np.int64, len(others))
                    new = ~np.isin(found, ids)
                    ids = np.concatenate([ids, found[new]])
                    sims = np.concatenate([sims, x[others[new]] @ x[own]])
                had = len(batch.column(6)[own])
                seen = np.concatenate([np.ones(had, bool), np.zeros(len(ids) - had, bool)])
                order = np.lexsort((ids, -sims))[: config.beam]
                out["row"].append(own)
                for name, values in (("ids", ids), ("sims", sims), ("seen", seen)):
                    out[name].append(values[order].tolist())
            chosen = batch.take(pa.array(out["row"], pa.int64()))
            arrays = [*chosen.columns[:4], pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["sims"], pa.list_(pa.float32())), pa.array(out["seen"], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "kind", "bytes", "scale", "ids", "sims", "seen"])

    while True:
        fresh = F.filter(F.arrays_zip("ids", "seen"), lambda e: ~e["seen"])
        front = pool.select("q", F.explode(F.transform(fresh, lambda e: e["ids"])).alias("id"))
        met = front.hint("merge").join(steps, "id").select("q", F.explode("next").alias("node")).distinct()
        met = met.hint("merge").join(graph.nodes, "node").select("q", F.lit(1).alias("kind"), "bytes", "scale", F.array("node").alias("ids"), F.lit(None).cast("array<float>").alias("sims"), F.lit(None).cast("array<boolean>").alias("seen"))
        dealt = pool.unionByName(met).repartition("q").sortWithinPartitions("q")
        moved = written(dealt.mapInArrow(advance, schema), "ann-pool")
        discard(pool)
        pool = moved
        spark.sparkContext._jvm.System.gc()
        if pool.where(F.exists("seen", lambda s: ~s)).isEmpty():
            break

    # exact scores; rows with the vector of a found node are all found, the smallest vec_ids suffice
    copies = graph.rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    salted = graph.rows.join(copies, "node").select("uid", "vec_id", "node", F.pmod(F.xxhash64("uid"), F.lit(64)).alias("salt"))
    for keys in (["node", "salt"], ["node"]):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("vec_id"), "uid"))
        salted = salted.withColumn("__place", first).where(F.col("__place") <= k + 1).drop("__place")
    alone = graph.rows.join(copies, "node", "left_anti").select("uid", "vec_id", "node")
    rows = alone.unionByName(salted.select("uid", "vec_id", "node"))
    vectors = graph.rows.where("uid = node").select("node", "embedding")
    found = pool.select(F.col("q").alias("q_node"), F.explode("ids").alias("node")).join(vectors, "node")
    pairs = queries.withColumnRenamed("node", "q_node").join(found, "q_node")
    scored = pairs.select("q_uid", "query_id", "node", inner(F.col("q_embedding"), F.col("embedding")).alias("score"))
    scored = scored.join(rows, "node").where("uid <> q_uid")
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scored.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, wanted: Column, k: int = 20, config: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """search() over an index for each number of components: as many indexes as the vectors have different lengths."""
    rows = usable(vectors)
    widths = [r["width"] for r in rows.select("width").distinct().orderBy("width").collect()]
    found = [search(_graph(rows.where(F.col("width") == w), config), wanted, k, config) for w in widths]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else none


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
