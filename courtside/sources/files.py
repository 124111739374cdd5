"""File manifests and which stored version answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import fixed
from courtside.functions.text import blank_to_null, text, trim
from courtside.operators.keys import lookup


def file_manifest(spark: SparkSession, paths: Sequence[str], sha256: bool = True, kind: str = "file",
                  wanted: Sequence[str] = ()) -> DataFrame:
    """Name, kind, exists, path, size, mtime and sha256 per file. Without hashes the contents are not read.

    ``wanted`` names files that must appear; a missing one is listed with ``exists`` false.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    rows = files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(kind).alias("kind"), F.lit(True).alias("exists"),
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        (F.sha2("content", 256) if sha256 else F.lit(None).cast("string")).alias("sha256"))
    if not wanted:
        return rows
    listed = spark.createDataFrame([(n,) for n in wanted], "name string")
    absent = listed.join(rows, "name", "left_anti").select(
        "name", F.lit(kind).alias("kind"), F.lit(False).alias("exists"), F.col("name").alias("path"),
        F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(None).cast("string").alias("sha256"))
    return rows.unionByName(absent)


def latest_files(manifest: DataFrame, n: int | None = 20, suffix: str = ".json") -> DataFrame:
    """Newest files first, ties by name; ``n`` is held to 1..100."""
    n = max(1, min(int(n or 20), 100))
    return (manifest.filter(F.col("name").endswith(suffix)).orderBy(F.col("mtime").desc(), F.col("name")).limit(n)
            .withColumn("event", F.regexp_replace("name", r"(?i)\.json$", "")))


def file_counts(manifest: DataFrame, suffix: str = ".json") -> DataFrame:
    """Number and size of the files."""
    return manifest.filter(F.col("exists") & F.col("name").endswith(suffix)).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def find_file(manifest: DataFrame, event: str) -> DataFrame:
    """The file of one event."""
    return manifest.filter(F.col("name") == F.lit(f"{event.strip()}.json"))


def files_to_refresh(source: DataFrame, target: DataFrame, only_missing: bool = False) -> DataFrame:
    """Source files that the target lacks or, unless ``only_missing``, holds in an older version."""
    have = target.filter("exists").select("name", F.col("mtime").alias("__target"))
    joined = lookup(source, have, ["name"])
    wanted = F.col("__target").isNull()
    if not only_missing:
        wanted = wanted | (F.col("mtime") > F.col("__target"))
    return joined.filter(wanted).drop("__target")


def transient_error(error: Column) -> Column:
    """The failure looks like one of transport."""
    condition = F.lit(False)
    for words in fixed.TRANSIENT_ERRORS:
        condition = condition | F.contains(text(error), F.lit(words))
    return condition


def choose_snapshot(snapshots: DataFrame, event: str, ended: Column, finished: Column, now: Column,
                    fetched_at: str = "fetched_at") -> DataFrame:
    """Which stored version of an event answers.

    ``snapshots`` has origin ("archive" or "live"), status ("ok", "empty" or "error"), error and ``fetched_at``.
    The archive answers an event that has ended; else a live version; after a live failure the archive answers when
    the event is finished or the failure is one of transport; else the result is an error with the archive's age.
    An empty live version is returned but marked as not to be kept.
    """
    rows = snapshots.withColumns({"__ended": F.coalesce(ended, F.lit(False)),
                                  "__finished": F.coalesce(finished, F.lit(False))})
    usable_archive = (F.col("origin") == "archive") & (F.col("status") == "ok")
    live_ok = (F.col("origin") == "live") & F.col("status").isin("ok", "empty")
    live_failed = (F.col("origin") == "live") & (F.col("status") == "error")
    newest = F.struct(F.col(fetched_at).alias("at"), F.col("status").alias("status"), F.col("error").alias("error"))
    # one row per event from aggregates that combine before the shuffle; the newest version of each kind
    events = rows.groupBy(event).agg(
        F.bool_or("__ended").alias("__ended"), F.bool_or("__finished").alias("__finished"),
        F.max(F.when(usable_archive, F.col(fetched_at))).alias("__archive"),
        F.max(F.when(live_ok, newest)).alias("__live"), F.max(F.when(live_failed, newest)).alias("__failed"))
    archive, live, failed = F.col("__archive").isNotNull(), F.col("__live"), F.col("__failed")
    excused = F.col("__finished") | transient_error(failed["error"])
    minutes = F.greatest(F.lit(1), F.floor((F.unix_timestamp(now) - F.unix_timestamp("__archive")) / 60 + 0.5)
                         ).cast("bigint")
    answer = (F.when((F.col("__ended") | F.col("__finished")) & archive, "archive")
              .when(live.isNotNull(), "live")
              .when(failed.isNotNull() & archive & excused, "archive")
              .otherwise("error"))
    return events.select(
        event, answer.alias("answer"),
        F.when(answer == "archive", F.col("__archive")).when(answer == "live", live["at"]).alias("answered_at"),
        F.when(answer == "error", F.when(archive, minutes)).alias("stale_minutes"),
        ((answer == "live") & (live["status"] == "ok")).alias("keep"))


def last_updated(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Age source of an archive: index ``lastFetchedAt``, else ``archivedAt``, else the file's own time."""
    files = manifest.select(F.regexp_replace("name", r"(?i)\.json$", "").alias("event"), F.col("mtime").alias("__file"))
    stamp = F.coalesce(blank_to_null(trim(F.col("lastFetchedAt"))), F.col("archivedAt"))
    return lookup(files, index.select("event", F.try_to_timestamp(stamp).alias("__index")), ["event"]).select(
        "event", F.coalesce("__index", "__file").alias("updated_at"))
