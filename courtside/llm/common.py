"""Shared pieces: tables in the shared folder, partition counts, columns that a table may lack."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.session import shuffles_dropped


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder that ``spark.checkpoint.dir`` names; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='courtside-')}"
    return f"{root.rstrip('/')}/courtside-llm/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once and read back: its lineage is cut, a lost executor loses nothing of it, and its shuffles go."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ``shared_folder`` whose tables nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions of the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; others, whatever they are called, never meet the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


_trimmed = [0.0]


def trim() -> None:
    """Gives memory that the worker has freed back to the machine, every other second at most: reused workers of several
    stages share an executor."""
    if time.monotonic() - _trimmed[0] > 2:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)
        _trimmed[0] = time.monotonic()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in parts of about ``most`` bytes of text or ``rows`` rows: what a task holds does not follow
    the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + most // rows) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if batch.num_rows else []
    for start, end in zip(edges[:-1], edges[1:]):
        yield batch.slice(int(start), int(end - start))
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
