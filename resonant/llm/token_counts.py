"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes holds signed rows: an insert adds a document and its tokens, a
delete takes them away, a revised count adds the difference. A batch is summed by
source, lang and version before anything moves. Its sums are added to the totals of
the last version, which gives the next version's; the work of a commit follows the
batch and the number of groups, not what was committed before.

A version becomes the last one when its entry in the log is created, which succeeds
for one of several writers only; the others add their sums to the new totals and try
again. The entry names the batch, and a mark is left for each batch, so that
committing a batch again does nothing: a retry after a lost driver or executor cannot
count twice. Old entries and totals are cleared away.

Defined cases
    null or empty text     no tokens, still a document
    very long texts        counted whole
    null source or lang    a group of its own
    null doc_id            counted; deletes and revisions find it by what they carry
    repeated rows          each is counted
    groups that sum to 0   left out of the totals
    empty batch            committed, changes nothing
    extra columns          not read
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.packing import vocabulary_path
from resonant.llm.shared import documents, scratch, text_of, written
from resonant.llm.tokens import shared_bpe
from resonant.session import ship

DELTA = "source string, lang string, version string, documents long, tokens long"
KEYS = ["source", "lang", "version"]
Counter = Callable[[DataFrame], DataFrame]


def by_words(version: str = "words-1", carry: dict[str, Column] | None = None) -> Counter:
    """Runs of characters other than white space, counted by Spark's own functions; carry adds columns."""

    def count(docs: DataFrame) -> DataFrame:
        tokens = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        more = [c.alias(n) for n, c in (carry or {}).items()]
        return docs.select("doc_id", "source", "lang", F.lit(version).alias("version"), tokens.alias("tokens"), *more)

    return count


def by_word_bpe(vocabulary: str, version: str = "word-bpe-49k-1") -> Counter:
    """Ids of the public word-piece tokenizer whose file lies at vocabulary on every machine."""

    def count(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = shared_bpe(vocabulary)
            for batch in batches:
                for lo in range(0, len(batch), 512):
                    part = batch.slice(lo, 512)
                    sizes = np.array([len(raw) // 4 for raw in bpe.encode_batch([t.as_py() or "" for t in part.column(3)])], np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * len(part), pa.string()), pa.array(sizes)], names=["doc_id", "source", "lang", "version", "tokens"])

        ship(docs.sparkSession)
        return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")

    return count


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(counted: DataFrame) -> DataFrame:
    """counted also has old_tokens; the document itself stays counted."""
    return counted.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.col("tokens") - F.col("old_tokens")).alias("tokens"))


class Unfinished(RuntimeError):
    """A log entry without content: its writer was lost, or is still writing."""


class Rollup:
    """Totals kept in a folder: log/<version> names a batch and a folder of totals, batches/<name> marks a batch.

    The log is as safe against concurrent writers as the file system's create without
    overwriting is.
    """

    KEEP = 3  # versions that stay readable

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}" if name else self.location)

    def _create(self, name: str, content: str = "") -> bool:
        """False if the file is there already."""
        at = self._path(name)
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError:
            if self._fs.exists(at):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def version(self) -> tuple[int, str, str]:
        """The last version, its batch and the name of its totals; 0 before any commit."""
        log = self._path("log")
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(log) if f.getPath().getName().isdigit()] if self._fs.exists(log) else []
        if not numbers:
            return 0, "", ""
        stream = self._fs.open(self._path(f"log/{max(numbers):012d}"))
        try:
            content = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not content.endswith("\n"):
            raise Unfinished(f"version {max(numbers)} of {self.location}")
        batch, totals = content.split()
        self._create(f"batches/{batch}")  # its writer may have been lost before this
        return max(numbers), batch, totals

    def recover(self) -> None:
        """Remove the entry of a writer that was lost while it wrote it; only when no writer is at work."""
        try:
            self.version()
        except Unfinished:
            log = self._path("log")
            last = max(f.getPath().getName() for f in self._fs.listStatus(log) if f.getPath().getName().isdigit())
            self._fs.delete(self._path(f"log/{last}"), False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if the batch is committed already."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
        self.version()
        if self._fs.exists(self._path(f"batches/{batch}")):
            return False
        sums = written(_summed(changes), "rollup-batch")
        while True:
            last, _, before = self.version()
            if self._fs.exists(self._path(f"batches/{batch}")):
                return False
            totals = f"totals/{last + 1:012d}-{uuid.uuid4().hex}"
            all_sums = sums if not before else sums.unionByName(self._read(before))
            _summed(all_sums).where("documents <> 0 OR tokens <> 0").write.parquet(f"{self.location}/{totals}")
            if self._create(f"log/{last + 1:012d}", f"{batch} {totals}\n"):
                break
            self._fs.delete(self._path(totals), True)  # another batch was first
        self._create(f"batches/{batch}")
        self._clear(last + 1)
        return True

    def _read(self, totals: str) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(f"{self.location}/{totals}")

    def _clear(self, last: int) -> None:
        """Remove what belongs to versions before the last KEEP."""
        for folder in ("log", "totals"):
            for f in self._fs.listStatus(self._path(folder)):
                number = f.getPath().getName().partition("-")[0]
                if number.isdigit() and int(number) <= last - self.KEEP:
                    self._fs.delete(f.getPath(), True)

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens of the last version."""
        _, _, totals = self.version()
        return self._read(totals) if totals else self.spark.createDataFrame([], DELTA)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents, the last one committed twice.

    The first inserts every document under the version chars-6, one token in six
    characters; the second does so under words-1, as a provisional count, and the
    third revises each to its true count; the fourth deletes all documents of chars-6,
    which retires that version; the fifth inserts the word-piece tokenizer's counts.
    """
    docs = documents(spark, sf_dir)
    rollup = Rollup(spark, scratch(spark, "rollup"))
    provisional = F.coalesce(F.floor(F.col("n_chars") / 6), F.lit(0)).cast("long")
    guessed = lambda version: docs.select("source", "lang", F.lit(version).alias("version"), provisional.alias("tokens"))
    rollup.commit("chars", inserts(guessed("chars-6")))
    rollup.commit("words-provisional", inserts(guessed("words-1")))
    rollup.commit("words-revised", revisions(by_words(carry={"old_tokens": provisional})(docs)))
    rollup.commit("chars-retired", deletes(guessed("chars-6")))
    pieces = inserts(by_word_bpe(vocabulary_path())(docs))
    for _ in range(2):
        rollup.commit("word-bpe", pieces)
    return rollup.totals()


#: The query's rows of the version words-1, for DuckDB.
WORDS_SQL = r"""
SELECT source, lang, 'words-1' AS version, count(*) AS documents,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM documents GROUP BY source, lang
"""
