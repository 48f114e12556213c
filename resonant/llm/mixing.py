"""Mixing sources to target weights.

Main path: DataFrame and SQL functions only.

The words of a source, document after document, are cut into blocks of a fixed
number of words. Each source has as many slots as its target asks for, and all slots
are dealt to output shards of a fixed size in a pseudorandom order: the source counts
of a shard are multinomial draws, given what the shards before have left of each
source, so that every shard is mixed and every source comes out at its target. A
source's slots are numbered across the shards; slot k takes the block at place k
modulo the number of blocks in a pseudorandom permutation of the source's blocks, and
a join by (source, place) brings the block.

Defined cases
    null or empty text    size 0, taken 0
    null source           a source of its own, ordered last
    null doc_id           allowed; such rows are ordered by their texts
    repeated rows         each row is a document of its own; rows with the same doc_id
                          are ordered by their texts, so that reruns agree whatever
                          the files' splits
    very long texts       counted and cut whole
    ties                  sources with the same limit by weight in the order of names
    one source, no words  target 0
    empty table           empty result
    extra columns         not read by `mix`, kept by `mixed_documents`
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonant.llm.shared import documents, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    block_words: int = 128
    shard_slots: int = 4096
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3  # times a source's size
    seed: int = 17


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  # doc_id, source, size, row_no, text_hash
    sources: DataFrame  # sid, source, size, target, blocks, slots, first
    pieces: DataFrame  # sid, block, row_no, first (word of the document), words
    counts: DataFrame  # shard, sid, count, first (slot of the source)
    order: DataFrame  # sid, place, block
    slots: DataFrame  # shard, sid, slot, place


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """sid, source, size, target for a table of one row per source.

    Sharing the excess by weight until no source is above its limit ends where
    every source has min(limit, level * weight) and the sum is all sizes. Sorted
    by limit / weight, the limited sources come first, which gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    s = sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("__w", F.get(weights, ((F.col("sid") - 1) % len(config.weights)).cast("int")))
    s = s.withColumn("__limit", (F.col("size") * config.most).cast("double"))
    s = s.withColumn("__ratio", F.col("__limit") / F.col("__w"))
    ordered = Window.orderBy("__ratio", "sid")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("__total", F.sum("size").over(everything).cast("double"))
    s = s.withColumn("__left", F.col("__total") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0)))
    s = s.withColumn("__level", F.try_divide("__left", F.sum("__w").over(after)))
    # the first source whose share at this level is not above its limit sets the level
    s = s.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "sid", "__level"))).over(everything)["__level"])
    target = F.least(F.col("__limit"), F.coalesce(F.col("__level") * F.col("__w"), F.lit(0.0)))
    return s.select("sid", "source", "size", target.alias("target"))


def chunks_for(rows: int) -> int:
    """As many chunks as a chunk has rows: neither the chunks nor their sums fill a task."""
    return max(1, math.isqrt(rows))


def running_sum(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Adds `before`: the sum of value over the rows of the same sid that come first.

    Rows have a column `chunk`; the order is chunk, then `order`. A sum per chunk
    is carried over the chunks, and only a chunk's rows meet in one task, so a
    source with a third of all rows is dealt over many tasks.
    """
    base = df.groupBy("sid", "chunk").agg(F.sum(value).alias("__sum"))
    carried = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__base", F.coalesce(F.sum("__sum").over(carried), F.lit(0))).drop("__sum")
    within = Window.partitionBy("sid", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(base, ["sid", "chunk"]).withColumn("before", F.col("__base") + F.col("__within")).drop("__base", "__within")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), key: str | None = None) -> Mix:
    """Draw the mix of all documents; see the module's text for the method.

    key names a column that tells rows apart; without it rows are numbered here.
    """
    spark, b = docs.sparkSession, config.block_words
    rows = written(
        docs.select("doc_id", "source", word_count(text_of()).alias("size"), (F.col(key) if key else F.monotonically_increasing_id()).alias("row_no"), F.xxhash64(F.lit(config.seed), text_of()).alias("text_hash")),
        "mix-rows",
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), config)
    sources = sources.withColumn("blocks", F.ceil(F.col("size") / b))
    slots = F.least(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("size"))).cast("long"), F.col("blocks") * config.most)
    sources = sources.withColumn("slots", F.coalesce(slots, F.lit(0).cast("long")))
    first = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = written(sources.withColumn("first", F.coalesce(F.sum("slots").over(first), F.lit(0).cast("long"))).coalesce(1), "mix-sources")
    n_rows, (n_slots, n_blocks) = rows.count(), sources.agg(F.sum("slots"), F.sum("blocks")).first()
    n_slots, chunks = n_slots or 0, chunks_for(n_rows)

    # where each document lies in its source's words, and the blocks it meets
    spread = F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(F.xxhash64(F.lit(config.seed), "doc_id"))
    named = sources.select(F.col("source").alias("__source"), "sid")
    placed = rows.where("size > 0").join(named, rows["source"].eqNullSafe(named["__source"]))
    placed = placed.select("sid", "doc_id", "row_no", "size", "text_hash", F.pmod(spread, F.lit(chunks)).alias("chunk"))
    placed = running_sum(placed, "size", ["doc_id", "text_hash", "size", "row_no"])
    at, last = F.floor(F.col("before") / b), F.floor((F.col("before") + F.col("size") - 1) / b)
    pieces = placed.select("sid", "row_no", "before", "size", F.explode(F.sequence(at, last)).alias("block"))
    start = F.greatest(F.col("before"), F.col("block") * b)
    stop = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * b)
    pieces = written(
        pieces.select("sid", "block", "row_no", (start - F.col("before")).alias("first"), (stop - start).alias("words"), (start == F.col("block") * b).alias("opens")),
        "mix-pieces",
    )

    # source counts of each shard: all slots in a pseudorandom order, dealt shard after shard
    width = max(1, n_slots // 4096)
    cells = sources.where("slots > 0").select(
        "sid", F.col("first").alias("__lo"), (F.col("first") + F.col("slots")).alias("__hi"),
        F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))).alias("__cell"),
    )
    draw = F.xxhash64(F.lit(config.seed), F.lit("draw"), "id")
    drawn = spark.range(n_slots).select("id", draw.alias("__draw"), F.lit(0).alias("sid"), F.lit(1).cast("long").alias("one"), F.pmod(F.xxhash64(draw), F.lit(chunks_for(n_slots))).alias("chunk"))
    drawn = running_sum(drawn, "one", ["__draw", "id"]).select("id", F.floor(F.col("before") / config.shard_slots).alias("shard"))
    drawn = drawn.withColumn("__cell", F.floor(F.col("id") / width)).join(cells, "__cell").where("id >= __lo AND id < __hi")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("count"))
    counts = counts.withColumn("chunk", F.floor(F.col("shard") / chunks_for(n_slots // config.shard_slots)))
    counts = running_sum(counts, "count", ["shard"]).select("shard", "sid", "count", F.col("before").alias("first"))
    counts = written(counts, "mix-counts")
    slots = counts.select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
    blocks = sources.select("sid", "blocks")
    slots = slots.join(blocks, "sid").select("shard", "sid", "slot", (F.col("slot") % F.col("blocks")).alias("place"))

    # a pseudorandom permutation of each source's blocks: their ranks by a hash
    rank_chunks = chunks_for(n_blocks or 0)
    hashed = pieces.where("opens").select("sid", "block", F.xxhash64(F.lit(config.seed), F.lit("place"), "sid", "block").alias("__hash"), F.lit(1).cast("long").alias("one"))
    hashed = hashed.withColumn("chunk", F.pmod(F.xxhash64("__hash"), F.lit(rank_chunks)))
    order = running_sum(hashed, "one", ["__hash", "block"]).select("sid", F.col("before").alias("place"), "block")
    return Mix(rows, sources, pieces, counts, order, slots)


def piece_uses(m: Mix) -> DataFrame:
    """sid, row_no, first, words, uses: how often the mix has each piece of a document."""
    used = m.slots.groupBy("sid", "place").agg(F.count("*").alias("uses"))
    used = used.join(m.order, ["sid", "place"]).select("sid", "block", "uses")
    return m.pieces.join(used, ["sid", "block"]).select("sid", "row_no", "first", "words", "uses")


def taken(m: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    words = piece_uses(m).groupBy("row_no").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    named = m.sources.select(F.col("source").alias("__source"), F.col("size").alias("source_size"), "target")
    rows = m.rows.join(named, m.rows["source"].eqNullSafe(named["__source"])).join(words, "row_no", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix as documents, with all columns of docs.

    The copy e of a document (0, 1, 2) holds the words of the blocks that the mix
    takes more than e times; copies without words are left out, and a copy that has
    all its words keeps the text unchanged. Other copies join their words by one
    space. Where docs has n_chars, it follows the text.
    """
    docs = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("__key")), "mix-docs")
    fields = docs.schema["__row"].dataType.names
    flat = docs.select(F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"), F.col("__row.text").alias("text"), "__key")
    m = mix(flat, config, key="__key")
    span = F.struct("first", "words", "uses")
    spans = piece_uses(m).groupBy("row_no").agg(F.array_sort(F.collect_list(span)).alias("__spans"), F.sum("words").alias("__covered"))
    sized = spans.join(m.rows.select("row_no", "size"), "row_no")
    copies = sized.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("__spans", lambda s: s["uses"])).cast("int") - 1)))
    chosen = F.filter("__spans", lambda s: s["uses"] > F.col("__copy"))
    copies = copies.withColumn("__chosen", chosen)
    whole = F.aggregate("__chosen", F.lit(0).cast("long"), lambda a, s: a + s["words"]) == F.col("size")
    copies = copies.select(F.col("row_no").alias("__key"), "__chosen", whole.alias("__whole"))
    out = docs.join(copies, "__key")
    words = F.split(F.regexp_replace(F.col("__row.text"), f"^{GAP}|{GAP}$", ""), GAP)
    # the array of one array gives the words a name, so that they are split once and not for each span
    spans_of = lambda w: F.flatten(F.transform("__chosen", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["words"].cast("int"))))
    cut = F.concat_ws(" ", F.get(F.transform(F.array(words), spans_of), F.lit(0)))
    text = F.when(F.col("__whole"), F.col("__row.text")).otherwise(cut)
    out = out.withColumn("__text", text)
    kept = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[kept.get(c, F.col(f"__row.`{c}`")).alias(c) for c in fields])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(documents(spark, sf_dir)))
