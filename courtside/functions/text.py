"""Text normalisers. Blank and missing text are the same thing here, as they are in the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside import fixed

# White space as the feeds' own tooling sees it: wider than Java's \s and than Spark's trim.
SPACE_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def rx(pattern: str) -> str:
    """A regex in which ``\\s`` means SPACE."""
    return pattern.replace(r"\s", SPACE)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(text(c), F.lit(SPACE_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in cols])


def collapse(c: Column) -> Column:
    return F.regexp_replace(text(c), SPACE + "+", " ")


def norm_text(c: Column) -> Column:
    """Lower case, quotes dropped, everything outside a-z0-9 is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "['’]", ""), "[^a-z0-9]+", " "))


def norm_search(c: Column) -> Column:
    """As norm_text, but letters and digits of every script stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "['’]", ""), r"[^\p{L}\p{N}]+", " "))


def norm_search_ascii(c: Column) -> Column:
    """norm_text whose all-digit words lose their leading zeros."""
    return F.regexp_replace(norm_text(c), r"(^| )0+(?=[0-9]+( |$))", "$1")


def norm_code(c: Column) -> Column:
    """Match code without surrounding space and trailing dashes."""
    return F.regexp_replace(trim(c), "-+$", "")


def norm_source(c: Column) -> Column:
    """Source alias to canonical source. The native spelling of the domestic source is accepted as well."""
    t = norm_text(c)
    return (F.when(trim(c) == fixed.DOMESTIC_SOURCE_NATIVE, fixed.DOMESTIC_SOURCE)
            .when((t == "") | t.isin(fixed.DEFAULT_SOURCE_ALIASES), fixed.DEFAULT_SOURCE)
            .when(t.isin(fixed.DOMESTIC_SOURCE_ALIASES), fixed.DOMESTIC_SOURCE)
            .otherwise(t))


def knockout_code(c: Column) -> Column:
    """the code names a knockout stage."""
    return norm_code(c).rlike("R32|R16|QF|SF|FN")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, for use inside lambdas where no column can be staged."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def look_up(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null when the key is not in it."""
    return F.try_element_at(literal_map(values), key)
