"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

Main path: DataFrame and SQL functions only.

Documents come in batches. A batch is summed up by digest, and a sort-merge anti-join
with the index leaves the digests that no earlier batch had; these are appended, and
only their documents stay. A table whose largest doc_ids should stay is dealt into
batches by doc_id, the larger ones first.

Defined cases
    null text          counts as the empty text; empty texts form one group
    very long texts    hashed whole
    null doc_id        allowed; loses to any non-null doc_id of its group
    equal doc_ids      repeated rows: exactly one row of the group stays
    empty table        empty result, nothing is appended
    extra columns      not read by `dedup`, kept by `unique_documents`
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.shared import documents, scratch, text_of, written


def folded(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def digest_of(text: Column) -> Column:
    """Binary SHA-256 of the folded text in UTF-8."""
    return F.unhex(F.sha2(folded(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, with the doc_id that stays for each.

    The table is bucketed and sorted by digest, so that a batch is the only side
    of the anti-join that moves. `location` holds the data; reopening the same
    location in a later session needs the same number of buckets.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int):
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet"
            f" OPTIONS (path '{location}')"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> DataFrame:
        """Add the digests that the index lacks and give their rows; adding a batch twice adds nothing."""
        fresh = written(groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti"), "dedup-fresh")
        (
            fresh.select("digest", "keep_id").write.mode("append").format("parquet").option("path", self.location)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        return fresh

    def close(self) -> None:
        """Forget the table's name in this session's catalog; the data stay where they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int, tasks: int) -> int:
    """One bucket for about two million digests; of fewer, as many as keep `tasks` tasks busy."""
    return max(4, min(tasks, rows // 20_000), rows // 2_000_000)


def open_index(spark: SparkSession, rows: int) -> DigestIndex:
    """A fresh index in the shared work folder, sized for `rows` digests."""
    location = scratch(spark, "digests")
    name = location.rpartition("/")[2].replace("-", "_")
    return DigestIndex(spark, name, location, buckets_for(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def larger_ids_first(docs: DataFrame, batches: int = 2) -> Column:
    """The batch of each row, so that no batch has a larger doc_id than an earlier one; null comes last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(batches - 1)
    width = max(1, -(-(high - low + 1) // batches))
    return F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / width).cast("int"), F.lit(batches - 1))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: Column | None = None, batches: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_no.

    batch numbers the rows from 0 to batches - 1, in the order in which they meet the
    index. A document is kept if the index lacks its digest when its batch comes and
    it has the largest doc_id of the batch's equal texts; keep_id is the doc_id that
    the index keeps for the digest, group_size counts the rows of all batches.

    The whole texts are read and hashed once. Groups are aggregated before the
    shuffle, so a text that a third of the rows share is one row per task; the
    join that hands the result back to the rows reads both sides from plain
    tables, which lets adaptive execution split a hot digest.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", digest_of(text_of()).alias("digest"), F.monotonically_increasing_id().alias("row_no"),
        (F.lit(0) if batch is None else batch).alias("batch"),
    )
    rows = written(rows, "dedup-rows")
    own = index is None
    index = index or open_index(spark, rows.count())
    best = F.max(F.struct("doc_id", "row_no"))
    met, fresh = [], []
    for number in range(batches):
        groups = rows.where(F.col("batch") == number).groupBy("digest").agg(best.alias("__best"), F.count("*").alias("size"))
        groups = groups.select("digest", "size", F.col("__best.doc_id").alias("keep_id"), F.col("__best.row_no").alias("keep_row"))
        met.append(written(groups, "dedup-groups"))
        fresh.append(index.append(met[-1]).select("digest", "keep_row"))
    sizes = reduce(DataFrame.unionByName, met).groupBy("digest").agg(F.sum("size").alias("group_size"))
    stays = reduce(DataFrame.unionByName, fresh)
    groups = written(sizes.hint("merge").join(index.table(), "digest").join(stays, "digest", "left"), "dedup-decided")
    if own:
        index.close()
    joined = rows.hint("merge").join(groups, "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_no",
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts move only where they must: a digest and doc_id decide by semi-join, and
    only rows repeated with the same doc_id and text pass a further aggregation.
    """
    decided = dedup(docs, batch=larger_ids_first(docs), batches=2)
    one = written(
        decided.groupBy(F.unhex("text_sha256").alias("__digest"), F.col("doc_id").alias("__doc_id"))
        .agg(F.count("*").alias("__copies"), F.max("kept").alias("__kept"))
        .where("__kept"),
        "dedup-kept",
    )
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), digest_of(text_of()).alias("__digest")
    )
    same = row["__digest"].eqNullSafe(one["__digest"]) & row["__row.doc_id"].eqNullSafe(one["__doc_id"])
    stay = row.hint("merge").join(one.select("__digest", "__doc_id", "__copies"), same)
    fields = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    single = stay.where("__copies = 1").select(*fields)
    if one.where("__copies > 1").isEmpty():
        return single
    many = stay.where("__copies > 1").groupBy("__row.doc_id", row["__digest"]).agg(F.first("__row").alias("__row"))
    return single.unionByName(many.select(*fields))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return dedup(docs, batch=larger_ids_first(docs), batches=2).drop("row_no")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
