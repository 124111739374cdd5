"""Search text of matches (E20) and of events."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.dates import comparable_date
from courtside.functions.names import Names, name_candidates
from courtside.functions.text import let, norm_search, norm_search_ascii, text, trim
from courtside.operators.trigrams import TrigramIndex

_NO_TEXT = "array<string>"


def _flat(arrays: Column) -> Column:
    return F.coalesce(F.flatten(arrays), F.array().cast(_NO_TEXT))


def _side_terms(c: Column, names: Names) -> Column:
    def of_name(x):
        return F.concat(name_candidates(x), F.array(names.player(x)))

    players = _flat(F.transform(F.coalesce(c["players"], F.array()), lambda p: F.concat(
        F.array(text(p["name"]), text(p["orgCode"])), of_name(p["name"]))))
    return F.concat(F.array(text(c["name"]), text(c["org"]), text(c["orgCode"])), of_name(c["name"]), players,
                    F.array(text(names.team_hit(c["org"])), text(names.team_hit(c["orgCode"]))))


def match_search_text(names: Names) -> Column:
    """E20 over the columns of a match row."""
    plain = [text(F.col(c)) for c in ("description", "subEventType", "roundLabel", "roundKey", "venue", "table",
                                      "startDateLocal", "startDateUtc")]
    teams = _flat(F.transform("teams", lambda t: F.array(
        text(t["name"]), text(t["org"]), text(t["orgCode"]), names.team(t), text(names.team_hit(t["org"])),
        text(names.team_hit(t["orgCode"])))))
    rubbers = _flat(F.transform("singles", lambda s: _flat(F.transform(
        F.coalesce(s["competitors"], F.array()), lambda c: _side_terms(c, names)))))
    sides = _flat(F.transform(F.coalesce("competitors", F.array()), lambda c: _side_terms(c, names)))
    terms = F.concat(F.array(*plain), F.coalesce("searchDateTokens", F.array().cast(_NO_TEXT)), teams, rubbers, sides)
    return norm_search(F.array_join(F.filter(terms, lambda t: t != ""), " "))


def event_haystack(event: Column, name: Column, extras: Column) -> Column:
    """Id, normalised name and normalised extra values of an event.

    Normalising the joined texts gives the joined normalised texts, because it ends every word at a space.
    """
    return F.trim(F.concat_ws(" ", F.lower(trim(event)), norm_search_ascii(
        F.concat_ws(" ", text(name), F.array_join(extras, " ")))))


def _is_date(query: str) -> bool:
    """A year and a month, maybe a day, parted by slashes or hyphens."""
    parts = [p.strip() for p in query.replace("/", "-").split("-")]
    return (2 <= len(parts) <= 3 and all(p.isascii() and p.isdigit() for p in parts) and len(parts[0]) == 4
            and all(len(p) <= 2 for p in parts[1:]))


def matches_query(haystack: Column, event: Column, query: str) -> Column:
    """The haystack holds the query, or holds all its words unless the query looks like a date. A blank query
    matches everything; a number also matches as part of the id."""
    q = norm_search_ascii(F.lit(query))
    date_like = _is_date(query)

    def found(hay):
        asked = F.filter(F.split(q, " "), lambda w: w != "")
        by_words = let(F.split(hay, " "), lambda words: F.forall(asked, lambda w: F.array_contains(words, w)))
        return F.contains(hay, q) if date_like else F.contains(hay, q) | by_words

    in_id = F.lit(False) if date_like else q.rlike(r"^\d+$") & F.contains(F.lower(trim(event)), q)
    return (q == "") | in_id | let(haystack, found)


def find_contains(spark: SparkSession, index: TrigramIndex, needle: str) -> DataFrame:
    """F6 over an index of search texts (E20): (key, text) of the rows that hold the needle."""
    return index.find(spark, [spark.range(1).select(norm_search(F.lit(needle))).first()[0]])


def find_events(spark: SparkSession, index: TrigramIndex, query: str) -> DataFrame:
    """E32 over an index of event haystacks by event. Whatever way a query matches, the haystack holds each of its words."""
    words = spark.range(1).select(norm_search_ascii(F.lit(query))).first()[0].split()
    return index.find(spark, words, matches_query(F.col("text"), F.col("key"), query))


def order_events(start: Column, end: Column, event: Column) -> list[Column]:
    """Start then end date, undated last, then ids in numeric order."""
    return [comparable_date(start).asc_nulls_last(), comparable_date(end).asc_nulls_last(),
            event.try_cast("bigint").asc_nulls_last(), event.asc()]


def top_events(df: DataFrame, start: str, end: str, event: str, n: int = 50) -> DataFrame:
    """O4."""
    return df.orderBy(*order_events(F.col(start), F.col(end), F.col(event))).limit(n)


def sort_domestic_events(df: DataFrame, event: str = "event") -> DataFrame:
    """O5."""
    return df.orderBy(F.col(event).try_cast("bigint").desc())
