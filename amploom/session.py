"""A session with the settings the library likes; on a cluster the submitter's own win."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "amploom", **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and small Arrow batches, as a row may be a long signal."""
    b = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Lower this session's Arrow batches to so many rows and bytes: the JVM and the worker each hold a whole batch."""
    name = "spark.sql.execution.arrow.max%sPerBatch"
    for what, most in (("Records", rows), ("Bytes", size)):
        now = spark.conf.get(name % what, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name % what, most)


_own_dir: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that all machines share (``spark.checkpoint.dir``; one of its own under a local master where none is set), read again: steps after it neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="amploom-"))
        base = _own_dir[0]
    path = f"{base.rstrip('/')}/amploom-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a running session, where it isn't installed."""
    root = Path(__file__).resolve().parent
    out = tempfile.mkdtemp()
    archive = shutil.make_archive(os.path.join(out, "amploom"), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
