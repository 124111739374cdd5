"""Stage numbers, gap filling and blocks of equal rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside import fixed
from courtside.functions.labels import norm_round
from courtside.functions.text import blank_to_null, trim
from courtside.operators.keys import join_on
from courtside.operators.ordered import Scope, neighbours

NO_NUMBER = 9007199254740991  # sorts a missing match number last


def number_present_stages(df: DataFrame, scope: Sequence[str], stage: str, ladder: Sequence[str],
                          out: str = "stage_number") -> DataFrame:
    """Rank of a ladder stage among the stages that occur in its scope, null off the ladder.

    Occurring stages are found by a distinct that aggregates before the shuffle, so the numbered table has at most one
    row per scope and ladder step; the rows only look their number up.
    """
    steps = F.array_position(F.lit(list(ladder)), F.col(stage))
    present = df.select(*scope, stage).withColumn("__step", steps).filter(F.col("__step") > 0).distinct()
    w = Window.partitionBy(*scope).orderBy("__step")
    numbers = present.select(*scope, stage, F.row_number().over(w).alias(out))
    return join_on(df, numbers, [*scope, stage])


def number_knockout_rounds(df: DataFrame, scope: Sequence[str], context: DataFrame | None = None) -> DataFrame:
    """W2 on match rows; ``context`` holds the rows that define presence, when they are not the rows themselves."""
    if context is None:
        return number_present_stages(df, scope, "roundKey", fixed.KNOCKOUT_LADDER)
    numbered = number_present_stages(context.select(*scope, "roundKey").distinct(), scope, "roundKey",
                                     fixed.KNOCKOUT_LADDER).filter("stage_number is not null")
    return join_on(df, numbered, [*scope, "roundKey"])


def fill_between_labels(df: DataFrame, scope: Scope, label: Column, successor: Column, out: str) -> DataFrame:
    """A run of blank labels takes the label around it.

    Equal neighbours give that label; only one neighbour gives its label; neighbours whose ``successor`` numbers are n
    and n + 1 give the earlier label; anything else stays blank.
    """
    value = F.when(trim(label) != "", F.struct(label.alias("label"), successor.alias("number")))
    near = neighbours(df, scope, value, "__previous", "__next")
    p, n = F.col("__previous"), F.col("__next")
    guess = (F.when(p.isNull(), n["label"]).when(n.isNull(), p["label"])
             .when(p["label"] == n["label"], n["label"])
             .when(n["number"] == p["number"] + 1, p["label"]))
    return near.withColumn(out, F.when(trim(label) != "", label).otherwise(guess)).drop("__previous", "__next")


def match_order_scope(keys: Sequence[str], width: int) -> tuple[dict[str, Column], Scope]:
    """Helper columns and scope that put matches in (number, seq) order, numberless ones last, in chunks of ``width``
    consecutive numbers."""
    number = F.coalesce(F.col("matchNumber"), F.lit(NO_NUMBER))
    columns = {
        "__number": number,
        "__number_chunk": F.floor(number / F.lit(width)).cast("bigint"),
        "__seq_chunk": F.when(F.col("matchNumber").isNull(), F.floor(F.col("seq") / F.lit(width))).otherwise(0)
                       .cast("bigint"),
    }
    return columns, Scope(keys, ["__number_chunk", "__seq_chunk"], ["__number", "seq"])


def infer_missing_rounds(matches: DataFrame, width: int = 4096) -> DataFrame:
    """W1 on match rows: per source, event and category in match-number order."""
    columns, scope = match_order_scope(["source", "event", "categoryName"], width)
    key = F.coalesce(F.col("roundKey"), F.lit(""))
    successor = F.regexp_extract(key, r"^knockout_round_(\d+)$", 1).try_cast("bigint")
    filled = fill_between_labels(matches.withColumns(columns), scope, F.col("roundLabel"), successor, "__filled")
    inferred = (trim(F.col("roundLabel")) == "") & (trim(F.col("__filled")) != "")
    description = F.concat(F.col("categoryName"), F.lit(" - "), F.col("__filled"), F.lit(" - Match "),
                           F.coalesce(F.col("matchNumber").cast("string"), F.lit("null")))
    return filled.withColumns({
        "roundKey": F.when(inferred, norm_round(F.col("__filled"))).otherwise(F.col("roundKey")),
        "description": F.when(inferred, description).otherwise(F.col("description")),
        "roundLabel": F.when(inferred, F.col("__filled")).otherwise(F.col("roundLabel")),
    }).drop("__filled", *columns)


def round_bucket(key: Column) -> Column:
    """Coarse kind of a round."""
    k = F.coalesce(key, F.lit(""))
    return (F.when(k.isin(fixed.KNOCKOUT_LADDER), "knockout")
            .when(is_group(k), "group")
            .when((k == "preliminary_round") | k.startswith("qualifying_round_") | k.contains("qualification"),
                  "qualifying")
            .otherwise("other"))


def is_group(key: Column) -> Column:
    return (key == "group") | key.startswith("group ") | key.endswith("_group")


def final_ok(key: Column, label: Column, status: Column) -> Column:
    """A1: an official final."""
    return (((F.lower(trim(key)) == "final") | (F.lower(trim(label)) == "final"))
            & (F.upper(trim(status)) == "OFFICIAL"))


def event_finished(df: DataFrame, event: Sequence[str], category: Column, ok: Column) -> DataFrame:
    """A1: an event is finished when it names a category and every named category has a row for which ``ok`` holds."""
    named = df.withColumn("__category", trim(category)).filter(F.col("__category") != "")
    per_category = named.groupBy(*event, "__category").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("__ok"))
    done = per_category.groupBy(*event).agg(F.bool_and("__ok").alias("finished"))
    return join_on(df.select(*event).distinct(), done, event).withColumn(
        "finished", F.coalesce("finished", F.lit(False)))


def matches_finished(matches: DataFrame) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col("categoryName")), F.col("subEventType"))
    return event_finished(matches, ["event"], name,
                          final_ok(F.col("roundKey"), F.col("roundLabel"), F.col("resultStatus")))
