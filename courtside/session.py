"""Session settings the plans rely on."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive execution measures a side before it broadcasts it and splits skewed join partitions, also where that
    costs one more shuffle. Texts are compared in UTC."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # rows that a Python task and its executor hold at once
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when its execution ends, not when the driver happens to collect its
    garbage: for a table that is written and read back, whose plan nothing executes again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint_location(spark: SparkSession, sink: str, fallback: str | None = None) -> str:
    """Checkpoint folder of the stream that writes to ``sink``, stable across restarts.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, else in the caller's own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("spark.checkpoint.dir is unset and no folder was given")
    return f"{root.rstrip('/')}/streams/{hashlib.sha256(sink.encode()).hexdigest()[:24]}"
