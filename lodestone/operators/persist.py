"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
HELD: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("held", default=None)
"""The intermediate tables of the innermost ``scratch`` of this thread; None outside of any."""

CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless their path has it already."""
    path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if getattr(context, "_lodestone_sent", False) or str(ROOT) in path or not ROOT.is_dir():
        return
    archive = Path(tempfile.mkdtemp()) / "lodestone.zip"  # the driver's own; Spark sends it on
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "lodestone").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(archive))
    if str(archive) in sys.path:
        sys.path.remove(str(archive))
    context._lodestone_sent = True


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine, as in tests."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    The shuffle files behind the write are removed as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    held = HELD.get()
    if held is not None:
        held.append((spark, path))
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables of ``persisted`` that this thread makes within: for steps whose results are stored elsewhere."""
    token = HELD.set([])
    try:
        yield
    finally:
        for spark, path in HELD.get():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        HELD.reset(token)


def result(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written out; the tables of ``persisted`` that it made on the way are deleted."""
    outer = HELD.get()
    with scratch():
        df = make()
        token = HELD.set(outer)
        try:
            return persisted(df, label)
        finally:
            HELD.reset(token)


SETTLED = 20_000


def settled(df: DataFrame, label: str, limit: int = SETTLED) -> DataFrame:
    """A short result as rows of its own, so that what it was made from can go; a longer one is written out and stays.

    Call it within ``scratch``; rows are at most ``limit`` on the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema)
    held = HELD.set(None)
    try:
        return persisted(df, label)
    finally:
        HELD.reset(held)
