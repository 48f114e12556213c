"""Work folder, lineage cuts and small expressions that the operators have in common."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
_SCOPE: ContextVar[str] = ContextVar("scope", default="query")
_MADE: dict[str, list[str]] = {}  # paths by scope
_ROOTS: dict[str, str] = {}  # folders of our own by application


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a session that names none gets one of ours: a temporary folder when the
    whole of Spark runs in this process (local master), else a folder beside the
    warehouse, which a cluster shares.
    """
    root = spark.conf.get(CHECKPOINT, None) or _ROOTS.get(spark.sparkContext.applicationId)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="resonant-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        _ROOTS[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the work folder, deleted when the driver's JVM ends."""
    scope = _SCOPE.get()
    path = f"{work_dir(spark)}/resonant/{scope}/{label}-{uuid.uuid4().hex}"
    if scope != "query":
        _MADE.setdefault(scope, []).append(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the work folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if "/resonant/" in folder:
            at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str, keep: DataFrame | None = None) -> Iterator[None]:
    """Tables made inside belong to `name`; those it made before go, but for what `keep` reads."""
    held = {f.rpartition("/")[0] for f in keep.inputFiles()} if keep is not None else set()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in _MADE.pop(name, []):
        if any(h.endswith(path.rpartition("/")[2]) for h in held):
            left.append(path)
        else:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    _MADE[name] = left
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(key: Column, salt: str, modulus: int) -> Column:
    """crc32(key as text) mod modulus; a null key gives null."""
    return F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
