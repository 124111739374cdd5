"""HTML text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.text import collapse, let, rx, text, trim

_TAG = r"<[^>]+>"
_BREAK = rx(r"(?i)<br\s*/?>")


def _numeric(c: Column, pattern: str, to_hex) -> Column:
    """Replace numeric entities in one pass: the text between them, zipped with their decoded characters."""
    parts = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)

    def decoded(entity):
        return F.when(entity.isNull(), "").otherwise(let(to_hex(entity), lambda point: F.when(
            F.length(point) <= 6, F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")).otherwise(entity)))

    return F.when(c.rlike(pattern), F.array_join(
        F.zip_with(parts, found, lambda p, e: F.concat(p, decoded(e))), "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Hexadecimal, decimal and the five named entities of the result pages."""
    def numeric(t):
        hexadecimal = _numeric(t, "(?i)&#x[0-9a-f]+;",
                               lambda e: F.regexp_replace(F.substr(e, F.lit(4), F.length(e) - 4), "^0+(?=.)", ""))
        return let(hexadecimal, lambda h: _numeric(
            h, r"&#\d+;", lambda e: F.coalesce(F.hex(F.substr(e, F.lit(3), F.length(e) - 3).try_cast("bigint")),
                                               F.lit("0000000"))))

    out = let(text(c), lambda t: F.when(t.contains("&#"), numeric(t)).otherwise(t))
    for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        out = F.regexp_replace(out, f"(?i)&{entity};", char)
    return out


def strip_html(c: Column) -> Column:
    """Line breaks stay, other tags become a space, runs of blanks shrink."""
    out = F.regexp_replace(F.regexp_replace(text(c), _BREAK, "\n"), _TAG, " ")
    out = decode_entities(out)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def html_title(c: Column) -> Column:
    """First third-level heading, else the page title, else blank."""
    h3 = r"(?is)<h3>(.*?)</h3>"
    heading = trim(collapse(F.regexp_replace(F.regexp_extract(text(c), h3, 1), _TAG, " ")))
    title = trim(collapse(F.regexp_extract(text(c), r"(?is)<title>(.*?)</title>", 1)))
    return F.when(text(c).rlike(h3), heading).otherwise(title)


def html_lines(c: Column) -> Column:
    """Texts between line breaks, entities decoded first, blanks dropped."""
    return F.filter(F.transform(F.split(decode_entities(c), _BREAK), strip_html), lambda s: s != "")


def joined_names(c: Column) -> Column:
    """The names of one anchor, joined by a space."""
    return trim(F.array_join(F.filter(F.transform(F.split(decode_entities(c), _BREAK),
                                                  lambda s: trim(collapse(strip_html(s)))), lambda s: s != ""), " "))


def affiliation(c: Column) -> Column:
    """Struct of affiliation and prefecture from ``club(prefecture)``."""
    def read(t):
        # the last bracket, when it ends the text and holds no other
        opened = F.length(F.substring_index(t, "(", -1))
        inner = F.substr(t, F.length(t) - opened + 1, opened - 1)
        closed = t.endswith(")") & t.contains("(") & ~inner.contains(")") & ~t.contains("\n")
        return F.struct(
            F.when(closed, trim(F.substr(t, F.lit(1), F.length(t) - opened - 1))).otherwise(t).alias("affiliation"),
            F.when(closed, trim(inner)).otherwise("").alias("prefecture"))

    return let(strip_html(c), read)
