"""Dedupe and merge rules. Order is always explicit: ``seq`` columns, never input order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.text import first_text, norm_code, trim
from courtside.operators.keys import join_on, pick_first


def _or_own(key: Column, *seq: Column) -> list[Column]:
    """Grouping columns under which a row without a key stands alone instead of joining one huge null group."""
    missing = key.isNull() | (key == "")
    return [F.nullif(key, F.lit("")), *[F.when(missing, s) for s in seq]]


def dedupe_first(df: DataFrame, scope: Sequence[str], key: Column, order: Sequence[str]) -> DataFrame:
    """A2: first row per key in ``order``; rows without a key all stay."""
    own = _or_own(key, *[F.col(c) for c in order])
    return pick_first(df, [*scope, *own], [F.col(c) for c in order])


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Response pages as one table with their position in ``page``; follow with dedupe_first."""
    out = None
    for i, p in enumerate(pages):
        p = p.withColumn("page", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """A3: last row per key, at the position of the key's first row. Rows with a null key are dropped, as
    the feed rule asks."""
    keyed = df.na.drop(subset=list(keys))
    places = keyed.groupBy(*keys).agg(F.min(seq).alias("__place"))
    last = pick_first(keyed, list(keys), [F.col(seq).desc()])
    return join_on(last, places, keys, "inner").withColumn(seq, F.col("__place")).drop("__place")


def dedupe_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], zero: Column, started: Column,
                place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A4: what a left-to-right fold keeps, when a candidate replaces the kept row if it scores and the kept row is a
    zero score, or if it has a start time and the kept row has none.

    The fold is not associative, so no ``max_by`` gives it, but its outcome has a closed form over the four classes of
    rows. A scored and started row, once met, is never replaced and replaces anything, so the first one wins. Without
    one, a zero-started row and a scored-unstarted row replace each other and both replace a row that is neither; the
    survivor is the first row of the last run of equal class. That needs only minima and maxima, which aggregate
    before the shuffle, and one join back: no group is collected. The kept row comes with ``first_position``.

    ``place`` may add columns to the slim table of keys with their ``first_position``; kept rows come with them. The keys are one
    struct, which is never null, so that the join and the pick share a shuffle.
    """
    zero, started = F.coalesce(zero, F.lit(False)), F.coalesce(started, F.lit(False))
    classed = df.withColumn("__class", F.when(~zero & started, "done").when(zero & started, "timed")
                            .when(~zero, "scored").otherwise("bare"))
    classed = classed.select(F.struct(*keys).alias("__fold"), *[c for c in classed.columns if c in order or c not in keys])
    position = F.struct(*order)

    def only(c):
        return F.when(F.col("__class") == c, position)

    ends = classed.groupBy("__fold").agg(
        F.min(position).alias("first_position"), F.min(only("done")).alias("__done"),
        F.max(only("timed")).alias("__timed"), F.max(only("scored")).alias("__scored"))
    timed, scored = F.col("__timed"), F.col("__scored")
    wins = (F.when(F.col("__done").isNotNull(), "done")
            .when(timed.isNull() & scored.isNull(), "bare")
            .when(scored.isNull() | (timed > scored), "timed").otherwise("scored"))
    target = ends.select("__fold", *[F.col("__fold")[k].alias(k) for k in keys], "first_position", wins.alias("__wins"),
                         F.when(wins == "timed", scored).when(wins == "scored", timed).alias("__after"))
    target = (place(target) if place else target).drop(*keys)
    # an equality would become a key of the join, and the pick would need a shuffle of its own
    wanted = (F.col("__class") >= F.col("__wins")) & (F.col("__class") <= F.col("__wins"))
    candidates = join_on(classed, target, ["__fold"], "inner", null_safe=False).filter(
        wanted & (F.col("__after").isNull() | (position > F.col("__after"))))
    kept = pick_first(candidates, ["__fold"], [F.col(c) for c in order])
    return kept.select(*[F.col("__fold")[c].alias(c) if c in keys else c for c in df.columns],
                       *[c for c in target.columns if c not in {"__fold", "__wins", "__after"}])


def merge_versions(preferred: DataFrame, fallback: DataFrame, scope: Sequence[str], key: Column, seq: str,
                   better: Sequence[Column]) -> DataFrame:
    """One row per key, the better by ``better`` (sort columns), on a tie the preferred one; rows without a key
    all stay. Fallback rows come first, new keys after them: the result's ``merged_seq`` sorts that way.

    Each side holds a key at most once (``dedupe_first``); of repeated preferred rows the later wins a tie.
    """
    both = (preferred.withColumn("__origin", F.lit(0))
            .unionByName(fallback.withColumn("__origin", F.lit(1)), allowMissingColumns=True))
    both = both.withColumn("__key", F.nullif(key, F.lit(""))).withColumn(
        "__place", F.struct((1 - F.col("__origin")).alias("origin"), F.col(seq).alias("seq")))
    versions = Window.partitionBy(*scope, "__key", F.when(F.col("__key").isNull(), F.col("__place")))
    ranked = both.withColumn("__n", F.row_number().over(versions.orderBy(*better, F.col("__origin").asc(), F.col(seq).desc())))
    ranked = ranked.withColumn("merged_seq", F.min("__place").over(versions))
    return ranked.filter(F.col("__n") == 1).drop("__n", "__key", "__place", "__origin")


def feed_code() -> Column:
    """Normalised code of a feed item, its own or its card's."""
    return norm_code(F.coalesce(F.col("documentCode"), F.col("match_card")["documentCode"]))


def missing_codes(minimal: DataFrame, primary: DataFrame, scope: Sequence[str], code: Column, wanted: Column,
                  seq: str) -> DataFrame:
    """Codes of the minimal list that the primary set lacks, once each, in order of appearance."""
    listed = (minimal.withColumn("code", code).filter((F.col("code") != "") & wanted)
              .groupBy(*scope, "code").agg(F.min(seq).alias("position")))
    known = primary.select(*scope, code.alias("code")).distinct()
    return join_on(listed, known, [*scope, "code"], "left_anti")


def merge_facts() -> dict[str, Column]:
    """Flat columns by which feed items and matches are compared (J9, J10, M2), so that merging carries no card.

    ``m_rule`` says whether a supplement replaces the row: always, never, or by start time and score.
    """
    card = F.col("match_card")
    nested, sides = card["teamParentData"]["extended_info"]["matches"], card["competitiors"]

    def size(c):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))

    def has(c):
        return trim(c) != ""

    ready = F.col("matchType").isNotNull() & F.col("categoryName").isNotNull() & F.col("competitors").isNotNull()
    as_match = (F.when(size(F.col("singles")) > 0, "never")
                .when(~F.col("matchType").eqNullSafe("team") | ~F.col("discipline").eqNullSafe("teams"), "always")
                .when(size(F.col("teams")) < 2, "always").otherwise("compare"))
    as_item = (F.when(card["teamParentData"].isNull(), "always").when(size(nested) > 0, "never")
               .when(size(sides) < 2, "always").otherwise("compare"))
    start = card["matchDateTime"]["startDateLocal"]
    return {
        "m_code": feed_code(),
        "m_nested": size(nested), "m_sides": size(sides),
        "m_zero": trim(F.coalesce(card["overallScores"], F.col("overallScore"))) == "0-0",
        "m_started": has(F.coalesce(start, F.col("startDateLocal"))),
        "m_rule": F.when(ready, as_match).otherwise(as_item),
        "m_rule_started": F.when(ready, has(F.col("startDateLocal"))).otherwise(has(start)),
        "m_rule_zero": F.when(ready, trim(F.col("overallScore"))).otherwise(trim(card["overallScores"])) == "0-0",
    }


FACTS = ["m_code", "m_nested", "m_sides", "m_zero", "m_started", "m_rule", "m_rule_started", "m_rule_zero"]


def recover(primary: DataFrame, recovered: DataFrame) -> DataFrame:
    """J6/J9 on rows with merge facts: more rubbers, more sides, a score that is not 0-0, a start time; on a tie the
    recovered row."""
    better = [F.col("m_nested").desc(), F.col("m_sides").desc(), F.col("m_zero").asc(), F.col("m_started").desc()]
    return merge_versions(recovered, primary, ["event"], F.col("m_code"), "seq", better)


def merge_recovered(primary: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered items merged into the primary set of their event, recovered ones preferred."""
    return recover(primary.withColumns(merge_facts()), recovered.withColumns(merge_facts())).drop(*FACTS)


def merge_by_rule(primary: DataFrame, supplement: DataFrame, scope: Sequence[str], key: str, seq: str,
                  replaces) -> DataFrame:
    """A supplement row replaces the primary row of its key when ``replaces(primary, supplement)`` (columns of
    structs) holds; new keys are appended, rows without a key stay on both sides. ``merged_seq`` gives the order."""
    columns = primary.columns
    scoped = [*scope, "__key", "__alone"]

    def side(df, origin, name):
        place = F.struct(F.lit(origin).alias("origin"), F.col(seq).alias("seq"))
        keyed = F.nullif(F.col(key), F.lit(""))
        # a row without a key is a group of its own: the join meets it with nothing, wherever it is
        return df.select(*scope, F.struct(*columns).alias(name), place.alias(f"{name}_place"), keyed.alias("__key"),
                         F.when(keyed.isNull(), place).alias("__alone"))

    joined = join_on(side(primary, 0, "__p"), side(supplement, 1, "__s"), scoped, "full_outer")
    p, s = F.col("__p"), F.col("__s")
    take = p.isNull() | (s.isNotNull() & F.coalesce(replaces(p, s), F.lit(False)))
    return joined.select(F.when(take, s).otherwise(p).alias("__row"),
                         F.coalesce("__p_place", "__s_place").alias("merged_seq")).select("__row.*", "merged_seq")


def supplement_replaces(p: Column, s: Column) -> Column:
    """J10 rule list, tried in order; ``p`` has merge facts."""
    return (F.when(p["m_rule"] == "never", False).when(p["m_rule"] == "always", True)
            .when(~p["m_rule_started"] & (trim(s["startDateLocal"]) != ""), True)
            .otherwise(p["m_rule_zero"] & (trim(s["overallScore"]) != "0-0")))


def supplement(primary: DataFrame, added: DataFrame, seq: str = "seq") -> DataFrame:
    """J10 on rows with merge facts; ``added`` are matches."""
    filled = added.withColumn("m_code", norm_code(F.col("documentCode")))
    for c, t in primary.dtypes:
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit(None).cast(t))
    return merge_by_rule(primary, filled, ["event"], "m_code", seq, supplement_replaces)


def merge_supplemental(primary: DataFrame, supplemental: DataFrame) -> DataFrame:
    """J10 on feed items or matches of many events."""
    return supplement(primary.withColumns(merge_facts()), supplemental).drop(*FACTS)


def enrich_missing(matches: DataFrame, archived: DataFrame, keys: Sequence[str], lacks: Column,
                   fill: dict[str, Column], seq: str | None = None) -> DataFrame:
    """Rows for which ``lacks`` holds take the ``fill`` columns from the archived row of the same key.

    ``fill`` maps a column to an expression over ``own`` (the row) and ``old`` (the archived row).
    """
    old = archived if seq is None else pick_first(archived, list(keys), [F.col(seq).desc()])
    old = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("old"))
    joined = join_on(matches.withColumn("__lacks", F.coalesce(lacks, F.lit(False))), old, keys, "left", null_safe=False)
    take = F.col("__lacks") & F.col("old").isNotNull()
    for name, expression in fill.items():
        joined = joined.withColumn(name, F.when(take, expression).otherwise(F.col(name)))
    return joined.drop("old", "__lacks")


def enrich_missing_details(matches: DataFrame, archived: DataFrame) -> DataFrame:
    """Team ties without rubbers take them, and a blank venue or table, from the archived tie of the same code."""
    detailed = (archived.filter((F.col("matchType") == "team") & (F.size("singles") > 0))
                .withColumn("__code", F.nullif(norm_code(F.col("documentCode")), F.lit(""))).filter("__code is not null"))
    lacks = (F.col("matchType") == "team") & ~(F.coalesce(F.size("singles"), F.lit(0)) > 0)
    out = enrich_missing(
        matches.withColumn("__code", F.nullif(norm_code(F.col("documentCode")), F.lit(""))),
        detailed.select("event", "__code", "seq", "venue", "table", "singles"), ["event", "__code"], lacks,
        {"venue": first_text(F.col("venue"), F.col("old.venue")),
         "table": first_text(F.col("table"), F.col("old.table")), "singles": F.col("old.singles")}, seq="seq")
    return out.drop("__code")


def upsert(current: DataFrame, updates: DataFrame, key: str, seq: str, present: str = "present") -> DataFrame:
    """Field-level merge. A field an update row carries (listed in its ``present`` array) wins even when null;
    of several update rows for a key the later wins field by field; absent fields keep the old value."""
    fields = [c for c in current.columns if c != key]
    new = updates.groupBy(key).agg(*[
        F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains(present, c), F.col(seq))).alias(f"__u_{c}")
        for c in fields if c in updates.columns])
    # max_by skips rows whose ordering is null, so a field that no update carries comes out null
    renamed = new.withColumnRenamed(key, "__key")
    joined = current.join(renamed, current[key] == renamed["__key"], "full_outer")
    out = [F.coalesce(F.col(key), F.col("__key")).alias(key)]
    for c in fields:
        out.append((F.when(F.col(f"__u_{c}").isNotNull(), F.col(f"__u_{c}.v")).otherwise(F.col(c))
                    if c in updates.columns else F.col(c)).alias(c))
    return joined.select(*out)
