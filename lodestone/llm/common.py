"""What the operators share: table access, text batches, shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_KEYS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
"""Arrow batches are bounded by bytes of text as well: each is held by the JVM and by the Python worker at once."""

JOIN_KEYS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k"}
"""A join sends a side to all executors by the bytes that a shuffle has measured, not by an estimate: Spark takes an explode
or ``mapInArrow`` to give as many rows as it reads, 33 times too few for the cells of a fingerprint."""

MADE: list[DataFrame] = []
"""Tables of ``materialize`` that are still there."""

DEALT_BELOW = 64
"""Documents that come in fewer pieces than this, and fewer than there are cores, are dealt to all cores: at most
64 pieces of ``spark.sql.files.maxPartitionBytes`` go through that shuffle, on a cluster of any size."""

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
"""Folds A-Z and nothing else; UTF-8 bytes above 0x7F stay."""

WORD_ONLY = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
"""Folds A-Z and turns every ASCII byte that is neither letter nor digit into a space."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; documents in few pieces (``DEALT_BELOW``) are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < min(cores, DEALT_BELOW) else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on one machine."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    This cuts the lineage with files that survive the loss of an executor. The
    shuffle files behind the write are removed as soon as it has ended. Joins are
    planned with ``JOIN_KEYS``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    held = {CLEANUP_KEY: "true"} | JOIN_KEYS
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    MADE.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for one in tables:
        path = getattr(one, "lodestone_path", None)
        if path is None:
            continue
        spark = one.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        MADE[:] = [t for t in MADE if t is not one]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete the tables of ``materialize`` that were made within, but those put into the list."""
    before = list(MADE)
    kept: list[DataFrame] = []
    yield kept
    release(*[t for t in MADE if not any(t is k for k in (*before, *kept))])


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that is planned outside of ``materialize``: it goes by its key, however few rows Spark takes it for."""
    return df.hint("merge")


def splittable(df: DataFrame, key: str) -> DataFrame:
    """An aggregate by ``key``, so put that a join by ``key`` can split a hot key of its other side.

    Spark splits a skewed partition only where both sides of a join come straight
    from an exchange. An aggregate brings its own, below it; the key taken anew
    (a long, unchanged) makes Spark exchange its rows, one a key, once more.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of one column each, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH_KEYS.items():
        spark.conf.set(key, value)


def map_text(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    column: str = "text",
    limit: int = 4 << 20,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size; ``fn`` maps one slice to one batch.

    ``after`` runs at the end of a partition: workers are reused by later stages
    and should hold nothing for them.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        if after is not None:
            after()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]
