"""Operator 9: secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text. Each candidate's value is hashed; the distinct repositories and
owners that hold it are counted over the corpus, pairs first, so a value that a third of all rows hold is summed
before it is shuffled. A value that many owners hold is a copied example; one of a single owner that does not look
made up is a live-looking credential of that owner.

Contract. A null text is an empty one. Patterns match leftmost and non-overlapping, each kind by itself, on code points;
``assign`` needs a value of 6 characters at least. Repeated rows are each reported; they count once for ownership. A
row without a source counts as one nameless repository. Every row of the input gives one row. Other columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, staged

# The pattern of each kind, the group of its value, and what a text must hold for it to match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, r"(?i:password|passwd|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, r"[0-9a-f]{24}"),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, r"gh[pousr]_[A-Za-z0-9]{36}"),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, r"xox[abprs]-[A-Za-z0-9-]{10}"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, r"eyJ[A-Za-z0-9_-]{8}"),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, r"-----BEGIN [A-Z ]*PRIVATE"),
}
BASE = ("assign", "access", "hex")
SHORTEST = {"assign": 6}
COPIED_OWNERS = 3        # owners from which on a value is a copied example
PLACEHOLDER = ("(?i:example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef)|"
               + "|".join(f"{c}{{6}}" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def spans(text: Column, kind: str) -> Column:
    """All matches of one kind in order, as (start, rank, end, kind, value); ends are exclusive.

    The text between matches and the matches themselves alternate, so their lengths give all places.
    """
    pattern, group, hint = KINDS[kind]
    rank = list(KINDS).index(kind)
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                        part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    found = F.aggregate(parts, empty, step)["out"]
    found = F.filter(found, lambda s: F.length(s["value"]) >= SHORTEST.get(kind, 1))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(_SPANS))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, in order, with commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, spans): every row with its spans by start, then kind."""
    rows = need(docs, "doc_id", "text", "source").withColumn("text", F.coalesce("text", F.lit("")))
    found = F.array_sort(F.concat(*[spans(F.col("text"), kind) for kind in KINDS]))
    return rows.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), found.alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners): distinct holders of each value. ``source`` is ``owner/repository`` or an owner."""
    source = F.coalesce("source", F.lit(""))
    held = candidates.select("hash", source.alias("repository")).distinct()
    per_owner = held.groupBy("hash", F.substring_index("repository", "/", 1).alias("owner")).agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def classified(found: DataFrame) -> DataFrame:
    """One row per span of ``find_secrets``: with the holders of its value and its class ``copied``, ``placeholder``,
    ``live`` or ``weak`` (one of few owners, but of one kind of character or short)."""
    candidates = found.select("doc_id", "source", "row", F.explode("spans").alias("s")).select(
        "doc_id", "source", "row", "s.*", F.sha2(F.col("s.value"), 256).alias("hash"))
    strong = (F.length("value") >= 16) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    kind = (F.when(F.col("owners") >= COPIED_OWNERS, "copied").when(F.col("value").rlike(PLACEHOLDER), "placeholder")
            .when(strong | (F.col("kind") == "pem"), "live").otherwise("weak"))
    return candidates.join(ownership(candidates), "hash").withColumn("class", kind)


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def query(docs: DataFrame) -> DataFrame:
    found = staged(find_secrets(docs), "found", shared_folder(docs.sparkSession))
    classes = classified(found).groupBy("row").agg(
        F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "copied").alias("n_copied"),
        F.max("owners").alias("most_owners"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.join(classes, "row", "left").select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_owners")])


def sql() -> str:
    """The query for DuckDB."""
    def kind_sql(rank: int, kind: str) -> str:
        pattern, group, _ = KINDS[kind]
        p = pattern.replace("'", "''")
        return f"""
  SELECT row, doc_id, source, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      s := CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      n := length(m[i]), v := v[i]))) AS x, {rank} AS rank, '{kind}' AS kind
  FROM (SELECT row, doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d)"""

    found = " UNION ALL ".join(kind_sql(r, k) for r, k in enumerate(KINDS))
    enough = " OR ".join(f"(kind = '{k}' AND length(x.v) >= {n})" for k, n in SHORTEST.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS source FROM documents),
f AS (SELECT row, doc_id, source, x.s AS s, x.s + x.n AS e, x.v AS v, rank, kind FROM ({found}) WHERE kind NOT IN ('{"', '".join(SHORTEST)}') OR {enough}),
o AS (SELECT v, COUNT(DISTINCT string_split(source, '/')[1]) AS owners FROM f GROUP BY v),
c AS (SELECT f.*, owners, CASE WHEN owners >= {COPIED_OWNERS} THEN 'copied' WHEN regexp_matches(f.v, '{PLACEHOLDER}') THEN 'placeholder'
        WHEN kind = 'pem' OR length(f.v) >= 16 AND regexp_matches(f.v, '[0-9]') AND regexp_matches(f.v, '[A-Za-z]') THEN 'live' ELSE 'weak' END AS class
      FROM f JOIN o ON f.v = o.v),
a AS (SELECT row, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access, COUNT(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
        COUNT(*) FILTER (class = 'live') AS n_live, COUNT(*) FILTER (class = 'copied') AS n_copied, MAX(owners) AS most_owners FROM c GROUP BY row)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
  sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied,
  COALESCE(most_owners, 0) AS most_owners
FROM d LEFT JOIN a ON d.row = a.row"""
