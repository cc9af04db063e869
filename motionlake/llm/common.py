"""Table access and shared scratch storage for the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII white space that the contracts name, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only in local mode, where none need be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "motionlake-scratch")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Deletes the shuffle files of an execution as soon as it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    return remember(out, path)


_PATHS: dict[int, tuple[str, str | None]] = {}


def remember(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Notes where ``df`` is stored, and under which table name, for ``discard``."""
    _PATHS[id(df)] = (path, table)
    weakref.finalize(df, _PATHS.pop, id(df), None)
    return df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` or ``remember`` noted, once nothing reads them any more; shared storage holds no more than is in use."""
    for t in tables:
        path, name = _PATHS.pop(id(t), (None, None))
        if name:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(col):
    """A-Z to a-z, every other character untouched (``lower`` would also change non-ASCII letters)."""
    return F.translate(col, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Sets the rows of an Arrow batch for the jobs started inside, and puts the session's own setting back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that workers hold few whole texts at once. Results that are
    not written yet are planned by the caller, so the limit stays; it bounds memory and changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null: empty."""
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


#: Rows of a few numbers each that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.count() <= rows else df
