"""Match archives: one JSON array per event on exchange, partitioned parquet at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import schema
from courtside.operators.normalize import normalize_feed
from courtside.sources.json_ranges import SPLIT_BYTES, json_records, large_files
from courtside.sources.paths import present


def _event(path: str = "_metadata.file_name") -> Column:
    """The event a file is named after; Spark shows file names URL-encoded."""
    return F.url_decode(F.regexp_extract(F.col(path), r"([^/]*)\.json$", 1))


def _read_arrays(spark: SparkSession, path: str, ddl: str, split_bytes: int) -> DataFrame:
    """Elements of JSON arrays: a file of up to ``split_bytes`` is parsed by one task, a larger one by byte ranges."""
    strict = {"mode": "FAILFAST"}
    rows = spark.read.schema(ddl).option("multiLine", True).options(**strict).json(path)
    large = large_files(spark, path, split_bytes)
    if large:
        rows = rows.filter(F.col("_metadata.file_size") <= split_bytes)
    small = rows.select(_event().alias("event"), F.monotonically_increasing_id().alias("seq"), *rows.columns)
    if not large:
        return small
    records = json_records(spark, large).select(_event("file").alias("event"), "seq", F.from_json("text", ddl, strict).alias("row"))
    return small.unionByName(records.select("event", "seq", "row.*"))


def read_items(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of ``<dir>/<event>.json`` files, feed items and normalised matches alike, in file order by ``seq``.

    A file larger than ``split_bytes`` must hold an array; it is read by as many tasks as it has byte ranges, none of which
    holds more than a record of it.
    """
    return _read_arrays(spark, path, schema.ARCHIVE_ROW, split_bytes)


def read_match_archive(spark: SparkSession, path: str) -> DataFrame:
    """S1 then P6: matches of every event under ``path``, a file, folder or pattern. A path that names nothing has no rows."""
    if not present(spark, path):
        return normalize_feed(spark.createDataFrame([], f"event string, seq bigint, {schema.ARCHIVE_ROW}"))
    return normalize_feed(read_items(spark, path))


def read_events(spark: SparkSession, path: str, ddl: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of JSON files named after their event (daily feed, standings blocks, event descriptions)."""
    return _read_arrays(spark, path, ddl, split_bytes)


def write_match_archive(matches: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Replaces the match set of every (source, event) in ``matches`` and no other.

    A large event is spread over tasks by its position, so that no task writes it alone.
    """
    keyed = matches.withColumn("source", F.coalesce("source", F.lit("default")))
    part = F.floor(F.col("seq") / F.lit(rows_per_file))
    (keyed.repartition(F.col("source"), F.col("event"), part)
     .sortWithinPartitions("source", "event", "seq")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source", "event").parquet(path))


def read_match_table(spark: SparkSession, path: str) -> DataFrame:
    """The parquet archive; a filter on source or event reads only its directories."""
    ddl = f"seq bigint, {schema.MATCH}, event string"
    return spark.read.schema(ddl).parquet(path)


def export_json(matches: DataFrame, path: str) -> None:
    """S6, exchange form: one folder per event with JSON lines in match order."""
    ordered = matches.repartitionByRange("event", "seq").sortWithinPartitions("event", "seq")
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("event").json(path)
