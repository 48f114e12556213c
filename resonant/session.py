"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1024


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's executors, once for each application.

    Rows go to Python in batches of at most BATCH_ROWS, since a row may hold a long text.
    """
    context = spark.sparkContext
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    if _SHIPPED.get("app") != context.applicationId:
        root = Path(__file__).parent
        handle, path = tempfile.mkstemp(prefix="resonant-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(os.path.abspath(path))
        _SHIPPED["app"] = context.applicationId
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver's JVM ends.

    Only a session that names none, on a local master, gets a temporary one; a cluster
    without the setting uses a folder beside its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.mkdtemp(prefix="resonant-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/resonant/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
