"""Match filters F1-F7 and the row limit, applied to all events at once with every event as its own scope."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside import fixed
from courtside.functions.labels import category_label, infer_gender, norm_discipline, norm_round
from courtside.functions.text import collapse, norm_search, text, trim
from courtside.operators.keys import join_on
from courtside.operators.stages import is_group, number_present_stages


@dataclass(frozen=True)
class MatchArgs:
    """Arguments of a match query."""

    category: str | None = None
    gender: str | None = None
    discipline: str | None = None
    rounds: tuple[str, ...] = ()
    contains: str | None = None
    code: str | None = None
    limit: int | None = None
    mode: str = "ja"
    omit_sets: bool = False

    def with_generic_category(self) -> MatchArgs:
        """A generic category fills a missing gender and discipline. "Mixed Teams" asks for teams, so that it finds
        its rows."""
        t = plain_text(self.category)
        if not self.category or t not in fixed.GENERIC_CATEGORIES:
            return self
        kind = "teams" if "team" in t else "mixed" if "mixed" in t else "singles" if "single" in t else "doubles"
        who = "mixed" if "mixed" in t else "women" if "women" in t else "men"
        return replace(self, gender=self.gender or who, discipline=self.discipline or kind)


def plain_text(value: str | None) -> str:
    """norm_text for an argument."""
    return re.sub("[^a-z0-9]+", " ", re.sub("['’]", "", (value or "").lower())).strip()


def is_generic(category: str) -> bool:
    t = plain_text(category)
    return not t or t in fixed.GENERIC_CATEGORIES


def drop_excluded(df: DataFrame, excluded: Column | None = None) -> DataFrame:
    """F1."""
    excluded = F.col("isParaClass") if excluded is None else excluded
    return df.filter(~F.coalesce(excluded, F.lit(False)))


def filter_category(df: DataFrame, scope: Sequence[str], wanted: str, category: str = "categoryName",
                    generic: bool | None = None) -> DataFrame:
    """rows of the wanted category; a generic category that no row of the scope has keeps the whole scope."""
    hit = category_label(F.col(category)) == category_label(F.lit(wanted))
    if not (is_generic(wanted) if generic is None else generic):
        return df.filter(hit)
    found = df.groupBy(*scope).agg(F.bool_or(hit).alias("__found"))
    return join_on(df, found, scope, "inner").filter(hit | ~F.col("__found")).drop("__found")


def filter_gender(df: DataFrame, wanted: str, gender: str = "gender") -> DataFrame:
    """an unknown word selects the rows without a gender."""
    return df.filter(F.col(gender).eqNullSafe(infer_gender(F.lit(wanted))))


def filter_discipline(df: DataFrame, wanted: str, discipline: str = "discipline") -> DataFrame:
    """F4."""
    return df.filter(F.col(discipline).eqNullSafe(norm_discipline(F.lit(wanted))))


def round_matches(key: Column, wanted: Column, stage_number: Column) -> Column:
    """F5 for one wanted round key."""
    qualifying = (key == "preliminary_round") | key.startswith("qualifying_round_") | is_group(key)
    nth = F.regexp_extract(wanted, r"^knockout_round_(\d+)$", 1).try_cast("bigint")
    return ((key == wanted) | ((wanted == "group") & is_group(key)) | ((wanted == "qualifying") & qualifying)
            | (wanted.isin("stage_1a", "stage_1b") & (key == F.concat(wanted, F.lit("_group"))))
            | F.coalesce(stage_number == nth, F.lit(False)))


def filter_rounds(df: DataFrame, scope: Sequence[str], wanted: Sequence[str], key: str = "roundKey",
                  ladder: Sequence[str] = fixed.KNOCKOUT_LADDER) -> DataFrame:
    """any of the wanted rounds. A numbered knockout round means the n-th stage present in the scope."""
    if not wanted:
        return df
    numbered = any("回戦" in w for w in wanted)
    rows = number_present_stages(df, scope, key, ladder, "__stage") if numbered else df.withColumn(
        "__stage", F.lit(None).cast("int"))
    condition = F.lit(False)
    for w in wanted:
        condition = condition | F.coalesce(round_matches(F.col(key), norm_round(F.lit(w)), F.col("__stage")),
                                           F.lit(False))
    return rows.filter(condition).drop("__stage")


def filter_contains(df: DataFrame, needle: str, search_text: Column) -> DataFrame:
    """F6."""
    return df.filter(F.contains(search_text, norm_search(F.lit(needle))))


def filter_code(df: DataFrame, code: str, column: str = "documentCode") -> DataFrame:
    """exact."""
    return df.filter(F.col(column) == F.lit(code))


def limit_rows(df: DataFrame, scope: Sequence[str], order: Sequence[str], n: int | None, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each scope; only a positive whole number limits.

    Rows are ranked in ``salts`` parts of their scope first, so that a large scope is never ranked in one task; what
    the parts keep, at most ``salts * n`` rows, is ranked again.
    """
    if not isinstance(n, int) or n <= 0:
        return df
    parted = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = Window.partitionBy(*scope, "__part").orderBy(*order)
    kept = parted.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= n)
    last = Window.partitionBy(*scope).orderBy(*order)
    return kept.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n", "__part")


def comparable(c: Column) -> Column:
    """Quote-free lower-case text with single spaces, the form facets compare."""
    return F.lower(trim(collapse(F.regexp_replace(text(c), "['’]", ""))))


def facet_scope(df: DataFrame, category: str | None = None, gender: str | None = None,
                discipline: str | None = None, columns: tuple[str, str, str] = ("categoryName", "gender", "discipline"),
                excluded: Column | None = None) -> DataFrame:
    """facet rows. Plain lower-case equality, no inference, unlike F3."""
    c, g, d = (F.col(x) for x in columns)
    out = drop_excluded(df, excluded)
    if category and plain_or_none(category):
        name = F.coalesce(F.nullif(c, F.lit("")), F.trim(F.concat_ws(" ", text(g), text(d))))
        out = out.filter(comparable(name) == plain_or_none(category))
    if gender and gender.strip():
        out = out.filter(F.lower(trim(g)) == gender.strip().lower())
    if discipline and discipline.strip():
        out = out.filter(F.lower(trim(d)) == discipline.strip().lower())
    return out


def plain_or_none(value: str) -> str:
    return re.sub(r"\s+", " ", re.sub("['’]", "", value)).strip().lower()
