"""Summaries and option lists (A5-A11), set differences (U2) and the alignment rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.labels import (
    category_option_label, category_option_sort_key, drop_prefix_for_domestic, round_ja, round_option_sort_value,
)
from courtside.functions.text import first_text, text, trim
from courtside.operators.keys import join_on
from courtside.operators.stages import number_knockout_rounds, round_bucket


def first_seen(df: DataFrame, scope: Sequence[str], value: Column, seq: Column, carried: dict[str, Column],
               out: str = "value") -> DataFrame:
    """Distinct non-blank values of a scope with the columns of the row that shows each first."""
    rows = df.withColumn(out, value).filter(F.coalesce(F.col(out), F.lit("")) != "")
    picked = rows.groupBy(*scope, out).agg(
        F.min(seq).alias("first_seq"), F.min_by(F.struct(*[c.alias(n) for n, c in carried.items()]), seq).alias("__c"))
    return picked.select(*scope, out, "first_seq", *[F.col(f"__c.{n}").alias(n) for n in carried])


def result_summary(matches: DataFrame, filtered: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A5: row counts before and after the filters."""
    before = matches.groupBy(*scope).agg(F.count(F.lit(1)).alias("fetched"))
    after = filtered.groupBy(*scope).agg(F.count(F.lit(1)).alias("returned"))
    return join_on(before, after, scope).withColumn("returned", F.coalesce("returned", F.lit(0)))


def available_rounds(df: DataFrame, scope: Sequence[str], label: str = "roundLabel", seq: str = "seq") -> DataFrame:
    """A5: distinct round labels; ``first_seq`` orders them."""
    labelled = df.filter(text(F.col(label)) != "")
    return labelled.groupBy(*scope, F.col(label).alias("round")).agg(F.min(seq).alias("first_seq"))


def category_options(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Categories of non-para matches with their label and sort key."""
    rows = df.filter(~F.coalesce("isParaClass", F.lit(False)))
    bare = F.trim(F.concat_ws(" ", text(F.col("gender")), text(F.col("discipline"))))
    options = first_seen(rows, scope, trim(F.coalesce(first_text(F.col("categoryName")), bare)), F.col("seq"), {
        "categoryName": F.col("categoryName"), "gender": F.col("gender"), "discipline": F.col("discipline")})
    labelled = options.withColumn("label", category_option_label(F.col("categoryName"), F.col("gender"),
                                                                 F.col("discipline")))
    return labelled.select(*scope, "value", "label", "first_seq",
                           category_option_sort_key(F.col("value"), F.col("label")).alias("sort_key"))


def round_options(df: DataFrame, scope: Sequence[str], rules, dictionary_rounds: DataFrame | None = None) -> DataFrame:
    """Round labels of the rows with their native label and sort value; stages are numbered over these rows."""
    numbered = number_knockout_rounds(df, scope)
    options = first_seen(numbered, scope, trim(F.col("roundLabel")), F.col("seq"), {
        "roundKey": F.col("roundKey"), "roundLabel": F.col("roundLabel"), "source": F.col("source"),
        "stage_number": F.col("stage_number")})
    translated = F.lit(None).cast("string")
    if dictionary_rounds is not None:
        renamed = dictionary_rounds.select(F.col("key").alias("roundKey"), F.col("value").alias("__translated"))
        options, translated = join_on(options, renamed, ["roundKey"], null_safe=False), F.col("__translated")
    label = drop_prefix_for_domestic(round_ja(F.col("roundKey"), F.col("roundLabel"), F.col("stage_number"),
                                              translated, rules), F.col("source"))
    return options.select(*scope, "value", label.alias("label"), "first_seq", round_option_sort_value(
        F.col("roundKey"), F.col("roundLabel"), F.col("stage_number")).alias("sort_value"))


def order_round_options(scope: Sequence[str]) -> list[Column]:
    """O3: by sort value, then by label in Japanese collation."""
    return [*[F.col(c) for c in scope], F.col("sort_value"), F.collate(F.col("label"), "ja")]


def category_report(df: DataFrame, scope: Sequence[str], category: str, label: Column, bucket: Column) -> DataFrame:
    """Matches, number of distinct rounds and which kinds of round a category has."""
    flags = {"has_knockout": "knockout", "has_group": "group", "has_qualifying": "qualifying", "has_other": "other"}
    rows = df.withColumns({"__label": F.nullif(label, F.lit("")), "__bucket": bucket})
    # distinct labels first: one row per label, not per match, reaches the second aggregation
    per_label = rows.groupBy(*scope, category, "__label", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    return per_label.groupBy(*scope, category).agg(
        F.sum("__n").alias("matches"), F.countDistinct("__label").alias("rounds"),
        *[F.bool_or(F.col("__bucket") == b).alias(name) for name, b in flags.items()])


def matches_report(matches: DataFrame) -> DataFrame:
    """A8 on match rows, para classes left out."""
    rows = matches.filter(~F.coalesce("isParaClass", F.lit(False)) & (text(F.col("categoryName")) != ""))
    return category_report(rows, ["event"], "categoryName", F.col("roundLabel"), round_bucket(F.col("roundKey")))


def suspicious_categories(listed: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every listed category with its report and the reasons it looks wrong (empty when it does not)."""
    joined = join_on(listed, report, keys, null_safe=False)
    no = F.lit(False)
    reasons = F.array(
        F.when(F.coalesce("has_group", no) & F.coalesce("has_knockout", no), "group_and_knockout_mixed"),
        F.when(F.coalesce("has_other", no), "unknown_round_bucket"),
        F.when(F.coalesce("matches", F.lit(0)) == 0, "listed_but_no_matches"))
    flags = ("has_knockout", "has_group", "has_qualifying", "has_other")
    return joined.withColumns({
        "matches": F.coalesce("matches", F.lit(0)), "rounds": F.coalesce("rounds", F.lit(0)),
        **{c: F.coalesce(c, no) for c in flags}, "suspicious": F.filter(reasons, lambda r: r.isNotNull())})


def set_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that only one side has, with ``side`` "left" or "right"."""
    a = left.select(*keys).distinct().withColumn("side", F.lit("left"))
    b = right.select(*keys).distinct().withColumn("side", F.lit("right"))
    return join_on(a, b, keys, "left_anti").unionByName(join_on(b, a, keys, "left_anti"))


def union_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """U3."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionByName(f.select(key))
    return out.distinct()


def index_summary(index: DataFrame) -> DataFrame:
    """Indexed events, how many are archived, how many of each status."""
    return index.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("archived")).alias("archived"),
                     F.count_if(F.col("status") == "live").alias("live"),
                     F.count_if(F.col("status") == "finished").alias("finished"),
                     F.count_if(F.col("status") == "upcoming").alias("upcoming"))
