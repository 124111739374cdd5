"""Keyed JSON indexes, dictionaries and label rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside import fixed
from courtside.sources.json_ranges import SPLIT_BYTES, entry_of, json_records, json_sections, large_files
from courtside.sources.paths import present


def _whole(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.text(path, wholetext=True) if present(spark, path) else None


def _parts(spark: SparkSession, path: str, split_bytes: int) -> tuple[DataFrame | None, list[str]]:
    """Small files, a row each, and the names of large ones."""
    text = _whole(spark, path)
    large = [] if text is None else large_files(spark, path, split_bytes)
    return (text.filter(F.col("_metadata.file_size") <= split_bytes) if large else text), large


def _entries(spark: SparkSession, large: list[str], corrupt: str) -> DataFrame:
    """(event, entry) of the keyed objects in large files; what is no entry makes its file corrupt."""
    records = json_records(spark, large, 1, "}", corrupt).withColumn("found", entry_of(F.col("text")))
    if corrupt == "raise":
        wrong = F.raise_error(F.concat(F.lit("no entry of a keyed object in "), "file"))
        records = records.withColumn("found", F.when(F.col("found").isNotNull(), F.col("found")).otherwise(wrong))
    else:
        broken = records.filter(F.col("found").isNull()).select("file").distinct()
        records = records.join(broken, "file", "left_anti")
    return records.select(F.explode("found").alias("event", "entry"))


def read_keyed_index(spark: SparkSession, path: str, value_ddl: str, corrupt: str = "empty",
                     split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """JSON object keyed by event to rows (event, fields, present).

    ``present`` lists the fields a row carries, null ones included. A missing file is empty; a corrupt one is empty or,
    with ``corrupt="raise"``, an error. A file larger than ``split_bytes`` is read by its byte ranges.
    """
    fields = [f for f in T.StructType.fromDDL(value_ddl).fields if f.name != "event"]
    value, names = T.StructType(fields), [f.name for f in fields]
    text, large = _parts(spark, path, split_bytes)
    if text is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("event", T.StringType()), *fields, T.StructField("present", T.ArrayType(T.StringType()))]))
    mode = {"mode": "FAILFAST"} if corrupt == "raise" else {}
    entries = text.select(F.explode(F.from_json("value", "map<string,string>", mode)).alias("event", "entry"))
    if large:
        entries = entries.unionByName(_entries(spark, large, corrupt))
    parsed = entries.select(
        "event", F.from_json("entry", value).alias("v"),
        F.map_keys(F.from_json("entry", "map<string,string>")).alias("present"))
    return parsed.select("event", *[F.col("v")[n].alias(n) for n in names], "present")


def read_event_names(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S3: (source, event, name). A text value belongs to the default source, an object to the source it is named by."""
    text, large = _parts(spark, path, split_bytes)
    if text is None:
        return spark.createDataFrame([], "source string, event string, name string")
    top = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    nested = F.col("v").startswith("{")
    plain = top.filter(~nested).select(F.lit(fixed.DEFAULT_SOURCE).alias("source"), F.col("k").alias("event"),
                                       F.col("v").alias("name"))
    named = top.filter(nested).select(F.col("k").alias("source"),
                                      F.explode(F.from_json("v", "map<string,string>")).alias("event", "name"))
    if large:
        flat, inner = json_sections(spark, large, corrupt="empty")
        plain = plain.unionByName(flat.select(F.lit(fixed.DEFAULT_SOURCE).alias("source"),
                                              F.explode(entry_of(F.col("text"))).alias("event", "name")))
        named = named.unionByName(inner.select(F.col("section").alias("source"),
                                               F.explode(entry_of(F.col("text"))).alias("event", "name")))
    # an object for the default source, when there is one, replaces the top-level names
    own = named.filter(F.col("source") == fixed.DEFAULT_SOURCE).select("source").distinct()
    return plain.join(own, "source", "left_anti").unionByName(named)


_KINDS = ["teams", "players", "rounds", "headers"]


def read_dictionary(spark: SparkSession, path: str, strict: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(kind, key, value) of the four maps. Strict: no player and no team is an error when the rows are read; for a file
    larger than ``split_bytes``, which is read by its byte ranges, when it is opened."""
    text, large = _parts(spark, path, split_bytes)
    empty = spark.createDataFrame([], "kind string, key string, value string")
    if text is None:
        return empty
    ddl = ", ".join(f"{k} string" for k in _KINDS)
    tops = text.select(F.from_json("value", ddl).alias("d"))
    if strict:
        counted = F.greatest(*[F.coalesce(F.size(F.map_keys(F.from_json(f"d.{k}", "map<string,string>"))), F.lit(0))
                               for k in ("teams", "players")])
        tops = tops.withColumn("d", F.when(counted > 0, F.col("d")).otherwise(
            F.raise_error(F.lit("dictionary holds neither teams nor players"))))

    def of_kind(kind):
        found = F.map_entries(F.from_json(f"d.{kind}", "map<string,string>"))
        rows = F.transform(found, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"),
                                                     e["value"].alias("value")))
        return F.coalesce(rows, F.array().cast("array<struct<kind:string,key:string,value:string>>"))

    pairs = F.concat(*[of_kind(k) for k in _KINDS])
    rows = tops.select(F.inline(pairs))
    for name in large:
        _, inner = json_sections(spark, [name], corrupt="raise" if strict else "empty")
        found = inner.filter(F.col("section").isin(_KINDS)).select(
            F.col("section").alias("kind"), F.explode(entry_of(F.col("text"))).alias("key", "value"))
        if strict and found.filter(F.col("kind").isin("teams", "players")).isEmpty():
            raise ValueError("dictionary holds neither teams nor players")
        rows = rows.unionByName(found)
    return rows


@dataclass(frozen=True)
class LabelRules:
    """Label settings with their defaults."""

    knockout_prefix: str = fixed.KNOCKOUT_PREFIX
    group_prefix: str = fixed.GROUP_PREFIX
    preliminary_round: str = fixed.PRELIMINARY_LABEL
    stage_display: dict = field(default_factory=lambda: dict(fixed.STAGE_DISPLAY))
    round_fallbacks: dict = field(default_factory=lambda: dict(fixed.ROUND_FALLBACKS))


def read_label_rules(spark: SparkSession, path: str) -> LabelRules:
    """One settings row. A blank label takes its default; maps that the file lacks are empty; the default maps
    apply only without a file."""
    text = _whole(spark, path)
    if text is None:
        return LabelRules()
    ddl = ("labels struct<knockoutPrefix:string,groupPrefix:string,preliminaryRound:string,"
           "stageDisplay:map<string,string>>, roundFallbacks map<string,string>")
    row = text.select(F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*").first()
    labels = row["labels"].asDict() if row["labels"] else {}
    return LabelRules(
        labels.get("knockoutPrefix") or fixed.KNOCKOUT_PREFIX, labels.get("groupPrefix") or fixed.GROUP_PREFIX,
        labels.get("preliminaryRound") or fixed.PRELIMINARY_LABEL, dict(labels.get("stageDisplay") or {}),
        dict(row["roundFallbacks"] or {}))


def write_sorted_index(index: DataFrame, path: str, key: str = "event") -> None:
    """JSON lines in numeric key order over the files in name order."""
    number = F.col(key).try_cast("bigint")
    (index.repartitionByRange(number.asc_nulls_last(), F.col(key)).sortWithinPartitions(number.asc_nulls_last(), key)
     .write.mode("overwrite").option("ignoreNullFields", "false").json(path))
