"""Dictionary joins. A dictionary is a (kind, key, value) table; a key occurs once per kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.names import compact_name, name_candidates
from courtside.functions.text import SPACE, text, trim
from courtside.operators.keys import join_on, lookup


def entries(dictionary: DataFrame, kind: str) -> DataFrame:
    return dictionary.filter((F.col("kind") == kind) & (F.col("value") != "")).select("key", "value")


def first_hit(values: DataFrame, candidates, dictionary: DataFrame) -> DataFrame:
    """(raw, value): for each distinct ``raw`` the value of its first candidate that the dictionary holds.

    Works on distinct values, so a value that fills a third of the rows is looked up once.
    """
    tried = values.select("raw").distinct().select("raw", F.posexplode(candidates).alias("pos", "key"))
    hits = lookup(tried, dictionary, ["key"], "inner")
    return hits.groupBy("raw").agg(F.min_by("value", "pos").alias("value"))


def translate_names(df: DataFrame, name: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Dictionary value of the first matching spelling, else the name itself, compacted."""
    hits = first_hit(df.select(F.col(name).alias("raw")), name_candidates(F.col("raw")), entries(dictionary, "players"))
    joined = lookup(df, hits.select(F.col("raw").alias(name), F.col("value").alias("__value")), [name])
    return joined.withColumn(out, compact_name(F.coalesce("__value", name))).drop("__value")


def translate_orgs(df: DataFrame, org: str, code: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Code, then text, then the parts of an ``A/B`` text one by one."""
    teams = entries(dictionary, "teams")
    pairs = df.select(org, code).distinct().withColumn("__org", trim(F.col(org))).withColumn("__code", trim(F.col(code)))
    parts = pairs.select(org, code, F.posexplode(F.split("__org", "/")).alias("pos", "key"))
    whole = lookup(pairs.withColumn("key", F.col("__org")), teams.withColumnRenamed("value", "__by_org"), ["key"])
    whole = lookup(whole.withColumn("key", F.col("__code")), teams.withColumnRenamed("value", "__by_code"), ["key"])
    joined = lookup(parts, teams, ["key"]).groupBy(org, code).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", "key").alias("v")))), lambda s: s["v"]), "/"
    ).alias("__by_part"))
    answer = (F.when(F.col("__by_code").isNotNull(), F.col("__by_code")).when(F.col("__org") == "", "")
              .otherwise(F.coalesce("__by_org", "__by_part")))
    resolved = join_on(whole, joined, [org, code]).select(org, code, answer.alias(out))
    return join_on(df, resolved, [org, code])


def lookup_descriptions(df: DataFrame, keys: Sequence[str], descriptions: DataFrame, seq: str) -> DataFrame:
    """Description of a key, the last one when a key occurs again."""
    last = descriptions.groupBy(*keys).agg(F.max_by("description", seq).alias("description"))
    return lookup(df, last, keys)


def translate_matches(matches: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("event", "seq")) -> DataFrame:
    """Adds ``player_names`` and ``team_names`` (raw to translated, hits only) and ``round_translated`` to matches.

    Names sit in nested arrays; they are exploded, resolved once per distinct name, and come back as one small map per
    match, so the report columns need no join.
    """
    sides = F.concat(F.coalesce("competitors", F.array()),
                     F.flatten(F.transform(F.coalesce("singles", F.array()),
                                           lambda s: F.coalesce(s["competitors"], F.array()))))
    flat = matches.select(*key, "teams", sides.alias("sides"))
    players = flat.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(
        "sides", lambda c: F.concat(F.array(text(c["name"])), F.coalesce(
            F.transform(c["players"], lambda p: text(p["name"])), F.array().cast("array<string>"))))))).alias("raw"))
    org_texts = F.concat(
        F.flatten(F.transform("sides", lambda c: F.concat(
            F.array(text(c["org"]), text(c["orgCode"])),
            F.flatten(F.coalesce(F.transform(c["players"], lambda p: F.array(text(p["org"]), text(p["orgCode"]))),
                                 F.array().cast("array<array<string>>")))))),
        F.flatten(F.transform(F.coalesce("teams", F.array()), lambda t: F.array(
            text(t["name"]), F.regexp_replace(text(t["name"]), SPACE + r"+\d+$", ""), text(t["org"]),
            text(t["orgCode"])))))
    whole = flat.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(org_texts, lambda o: F.concat(
        F.array(o, trim(o)), F.split(trim(o), "/")))))).alias("raw"))

    def as_map(found: DataFrame, out: str) -> DataFrame:
        return found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("raw", "value"))).alias(out))

    player_hits = first_hit(players, name_candidates(F.col("raw")), entries(dictionary, "players"))
    player_map = as_map(lookup(players, player_hits.withColumn("value", compact_name(F.col("value"))), ["raw"],
                               "inner"), "player_names")
    team_map = as_map(lookup(whole, entries(dictionary, "teams").withColumnRenamed("key", "raw"), ["raw"], "inner"),
                      "team_names")
    rounds = entries(dictionary, "rounds").select(F.col("key").alias("roundKey"), F.col("value").alias("round_translated"))
    out = join_on(join_on(matches, player_map, key), team_map, key)
    return lookup(out, rounds, ["roundKey"])


def without_dictionary(matches: DataFrame) -> DataFrame:
    """The columns of translate_matches for a query that has no dictionary."""
    nothing = F.lit(None).cast("map<string,string>")
    return matches.withColumns({"player_names": nothing, "team_names": nothing,
                                "round_translated": F.lit(None).cast("string")})
