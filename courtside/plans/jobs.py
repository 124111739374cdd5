"""Whole jobs over all events (Q1-Q9)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside import fixed
from courtside.functions.dates import date_range_label, date_search_values, lifecycle_status
from courtside.functions.labels import category_label, governing_body, indexable_name, results_preferred_name, series
from courtside.functions.names import Names
from courtside.functions.text import blank_to_null, first_text, knockout_code, text, trim
from courtside.operators import facets, filters, index as ix, report, search, stages
from courtside.operators.filters import MatchArgs
from courtside.operators.keys import join_on, lookup
from courtside.operators.lookup import entries, translate_matches, without_dictionary
from courtside.operators.merge import feed_code, missing_codes, recover, supplement, upsert
from courtside.operators.normalize import normalize_feed
from courtside.operators.ordered import Scope, number_rows
from courtside.operators.staged import written
from courtside.schema import MATCH_COLUMNS
from courtside.sources.archive import write_match_archive
from courtside.sources.index import LabelRules, write_sorted_index

EVENT = ["event"]


def apply_filters(matches: DataFrame, args: MatchArgs, translated: bool) -> DataFrame:
    """F1-F7 and O6 in their fixed order. ``translated`` matches carry the columns of ``translate_matches``."""
    out = filters.drop_excluded(matches)
    if args.category:
        out = filters.filter_category(out, EVENT, args.category)
    if args.gender:
        out = filters.filter_gender(out, args.gender)
    if args.discipline:
        out = filters.filter_discipline(out, args.discipline)
    if args.rounds:
        out = filters.filter_rounds(out, EVENT, args.rounds)
    if args.contains:
        names = Names(F.col("player_names"), F.col("team_names")) if translated else Names()
        out = filters.filter_contains(out, args.contains, search.match_search_text(names))
    if args.code:
        out = filters.filter_code(out, args.code)
    return filters.limit_rows(out, EVENT, ["seq"], args.limit)


def render_context(matches: DataFrame, args: MatchArgs) -> DataFrame:
    """Rows that define which stages are present: all rows of the category, or of the gender and discipline."""
    if args.category and not filters.is_generic(args.category):
        return matches.filter(category_label(F.col("categoryName")) == category_label(F.lit(args.category)))
    if args.gender:
        matches = filters.filter_gender(matches, args.gender)
    if args.discipline:
        matches = filters.filter_discipline(matches, args.discipline)
    return matches


def match_rows(matches: DataFrame, args: MatchArgs, dictionary: DataFrame | None = None) -> DataFrame:
    """Q1 without rendering: filtered matches with stage numbers and translations."""
    args = args.with_generic_category()
    named = without_dictionary(matches) if dictionary is None else translate_matches(matches, dictionary)
    filtered = apply_filters(named, args, dictionary is not None)
    return stages.number_knockout_rounds(filtered, EVENT, context=render_context(matches, args))


def match_query(matches: DataFrame, args: MatchArgs, dictionary: DataFrame | None = None,
                rules: LabelRules | None = None, ranged: bool = False) -> DataFrame:
    """Q1: report lines of every event. Unknown modes are the native report (R5). ``ranged``: see ``sort_matches``."""
    rows = match_rows(matches, args, dictionary)
    if args.mode == "json":
        return rows.select("event", F.col("seq").alias("row_no"), F.lit(0).alias("line_no"),
                           report.to_json_rows(rows, MATCH_COLUMNS))
    if args.mode == "list":
        return report.report_list(rows)
    if args.mode == "en":
        return report.report_en(rows, args.omit_sets, ranged)
    if args.mode == "text":
        return report.report_text(rows)
    return report.report_ja(rows, rules or LabelRules(), args.omit_sets, translated=dictionary is not None, ranged=ranged)


def match_facets(matches: DataFrame, args: MatchArgs, rules: LabelRules | None = None,
                 dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Q2: counts, available rounds, category options (without the category argument) and round options (with it)."""
    named = without_dictionary(matches) if dictionary is None else translate_matches(matches, dictionary)
    filtered = apply_filters(named, args.with_generic_category(), dictionary is not None)
    for_categories = filters.facet_scope(matches, None, args.gender, args.discipline)
    for_rounds = filters.facet_scope(matches, args.category, args.gender, args.discipline)
    return {
        "summary": facets.result_summary(matches, filtered, EVENT),
        "rounds": facets.available_rounds(matches, EVENT),
        "categories": facets.category_options(for_categories, EVENT),
        "round_options": facets.round_options(for_rounds, EVENT, rules or LabelRules(),
                                              None if dictionary is None else entries(dictionary, "rounds")),
    }


def searchable_events(archive: DataFrame, search_index: DataFrame, dates: DataFrame, names: DataFrame, now: Column,
                      bases: ix.UrlBases, overrides: DataFrame | None = None) -> DataFrame:
    """Q3 columns of every displayable event of the default source."""
    fields = ["eventName", "title", "startDate", "endDate", "archived", "status", "series", "source"]
    merged = ix.merge_event_indexes(archive, search_index, dates, "event", fields, present="present")
    stored = names.filter(F.col("source") == fixed.DEFAULT_SOURCE).select("event", F.col("name").alias("__stored"))
    merged = lookup(merged, stored, ["event"])
    if overrides is None:
        merged = merged.withColumn("__url", F.lit(None).cast("string"))
    else:
        merged = lookup(merged, overrides.select("event", F.col("url").alias("__url")), ["event"])
    merged = merged.withColumn("__name", text(first_text(F.col("eventName"), F.col("title"), F.col("__stored"))))
    shown = merged.filter(indexable_name(F.col("__name")))
    start, end, name = F.col("startDate"), F.col("endDate"), F.col("__name")
    return shown.select(
        F.lit(fixed.DEFAULT_SOURCE).alias("source"), "event", name.alias("eventName"),
        ix.event_url(F.col("event"), F.col("source"), name, bases, F.col("__url")).alias("eventUrl"),
        blank_to_null(start).alias("startDate"), blank_to_null(end).alias("endDate"),
        date_range_label(start, end).alias("dateLabel"),
        F.coalesce(F.col("archived").cast("boolean"), F.lit(False)).alias("archived"),
        lifecycle_status(start, end, F.coalesce(blank_to_null(F.col("status")), F.lit("unknown")), name, now)
        .alias("status"),
        F.coalesce(blank_to_null(F.col("series")), series(name)).alias("series"),
        governing_body(name).alias("governingBody"))


def event_search(events: DataFrame, query: str, discovered: DataFrame | None = None, meta: DataFrame | None = None,
                 n: int = 50) -> DataFrame:
    """Q3: events that match the query, earliest first, at most ``n``.

    A numeric query also gives the event of that id dates and status from ``meta`` (event, startDate, endDate,
    dateLabel, status) when it has no date, and, when it finds no event of that id, puts the one resolved from its own
    matches (``discovered``, same columns as ``events``) first.
    """
    hay = search.event_haystack(F.col("event"), F.col("eventName"), date_search_values(
        F.col("startDate"), F.col("endDate"), F.col("dateLabel")))
    hits = events.filter(search.matches_query(hay, F.col("event"), query))
    order = search.order_events(F.col("startDate"), F.col("endDate"), F.col("event"))
    wanted = query.strip()
    if not re.match(r"^\d+$", wanted) or (discovered is None and meta is None):
        return hits.orderBy(*order).limit(n)
    top = hits.orderBy(*order).limit(n).withColumn("__first", F.lit(1))
    if meta is not None:
        dated = meta.filter(F.col("event") == wanted).select("event", F.struct(
            "startDate", "endDate", "dateLabel", "status").alias("__m"))
        use = (F.col("event") == wanted) & (text(F.col("dateLabel")) == "") & F.col("__m").isNotNull()
        top = lookup(top, dated, ["event"])
        top = top.withColumns({c: F.when(use, first_text(F.col("__m")[c], F.col(c))).otherwise(F.col(c))
                               for c in ("startDate", "endDate", "dateLabel", "status")}).drop("__m")
    if discovered is not None:
        own = discovered.filter(F.col("event") == wanted).withColumn("__first", F.lit(0))
        top = join_on(own, top.filter(F.col("event") == wanted).select("event"), EVENT, "left_anti").unionByName(top)
    return top.orderBy("__first", *order).limit(n).drop("__first")


def discovered_events(verified: DataFrame, bases: ix.UrlBases) -> DataFrame:
    """Q3: search rows of events resolved from their own matches (``verified_entries``)."""
    return verified.select(
        F.lit(fixed.DEFAULT_SOURCE).alias("source"), "event", "eventName",
        ix.event_url(F.col("event"), F.col("source"), F.col("eventName"), bases).alias("eventUrl"), "startDate", "endDate",
        "dateLabel", "archived", "status", "series", governing_body(F.col("eventName")).alias("governingBody"))


def domestic_search(names: DataFrame, query: str, page_base: str) -> DataFrame:
    """Q3 for the domestic source: named events only, always finished, newest id first."""
    own = names.filter(F.col("source") == fixed.DOMESTIC_SOURCE)
    hay = search.event_haystack(F.col("event"), F.col("name"), F.array().cast("array<string>"))
    hits = own.filter(search.matches_query(hay, F.col("event"), query)).select(
        "source", "event", F.col("name").alias("eventName"),
        F.concat(F.lit(page_base), ix.url_part(F.col("event")), F.lit("/")).alias("eventUrl"),
        F.lit("").alias("dateLabel"), F.lit(True).alias("archived"), F.lit("finished").alias("status"))
    return search.sort_domestic_events(hits)


def verified_entries(matches: DataFrame, meta: DataFrame, names: DataFrame, now: Column, verified_at: str) -> DataFrame:
    """Q4: search-index entry of every event that has matches and an indexable name."""
    present = matches.select("event").distinct()
    done = stages.matches_finished(matches).withColumnRenamed("finished", "__done")
    rows = lookup(lookup(lookup(present, meta, ["event"]), names.select("event", F.col("name").alias("__own")), ["event"]),
                  done, ["event"])
    name = trim(first_text(F.col("title"), F.col("__own")))
    finished = F.coalesce("isFinished", F.lit(False)) | F.coalesce("__done", F.lit(False))
    return rows.filter(indexable_name(name)).select(
        "event", name.alias("eventName"), blank_to_null(F.col("startDate")).alias("startDate"),
        blank_to_null(F.col("endDate")).alias("endDate"),
        date_range_label(F.col("startDate"), F.col("endDate")).alias("dateLabel"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        lifecycle_status(F.col("startDate"), F.col("endDate"), F.when(finished, "finished").otherwise("unknown"), name,
                         now).alias("status"),
        F.coalesce(blank_to_null(F.col("source")), F.lit(fixed.DEFAULT_SOURCE)).alias("source"),
        series(name).alias("series"), F.lit(verified_at).alias("verifiedAt"))


def build_event_index(probed: DataFrame, entries_found: DataFrame, archive: DataFrame, dates: DataFrame,
                      old: DataFrame, now: Column, verified_at: str, path: str | None = None) -> DataFrame:
    """Q4: entries replace the old ones of the probed ids, probed ids without an entry lose theirs; then the archive
    and the date index are merged in. Written in numeric order when ``path`` is given."""
    kept = old.select(*entries_found.columns).join(probed.select("event").distinct(), "event", "left_anti")
    base = kept.unionByName(entries_found)
    merged = ix.merge_archive_into_index(base, archive, now, verified_at)
    merged = ix.merge_dates_into_index(merged, dates, now, verified_at)
    if path:
        write_sorted_index(merged, path)
    return merged


def alignment_check(listed: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: (categories on one side only, report per listed category). ``listed`` is (event, subEventName,
    subEventDrawTypeId, seq); the first row of a category names its draw type."""
    named = listed.filter(text(F.col("subEventName")) != "").select(
        "event", F.col("subEventName").alias("categoryName"), "subEventDrawTypeId", "seq")
    source = named.groupBy("event", "categoryName").agg(F.min_by("subEventDrawTypeId", "seq").alias("drawType"))
    ours = matches.filter(~F.coalesce("isParaClass", F.lit(False)) & (text(F.col("categoryName")) != ""))
    diff = facets.set_diff(source, ours, ["event", "categoryName"])
    checked = facets.suspicious_categories(source, facets.matches_report(matches), ["event", "categoryName"])
    return diff, checked


def archive_events(matches: DataFrame, meta: DataFrame, current: DataFrame, path: str, archived_at: str,
                   force: bool = False) -> DataFrame:
    """Q6: writes the matches of finished events (of all when forced) and returns the updated archive index."""
    chosen = meta if force else meta.filter("isFinished")
    kept = join_on(matches, chosen.select("event"), ["event"], "left_semi", null_safe=False)
    write_match_archive(kept, path)
    fields = ["archived", "source", "title", "startDate", "endDate", "canAutoArchive", "archivedAt", "forced"]
    updates = chosen.select(
        "event", F.lit(True).alias("archived"), F.coalesce("source", F.lit(fixed.DEFAULT_SOURCE)).alias("source"),
        text(F.col("title")).alias("title"), "startDate", "endDate", "canAutoArchive",
        F.lit(archived_at).alias("archivedAt"), (F.lit(force) & ~F.col("isFinished")).alias("forced"),
        F.lit(0).cast("bigint").alias("seq"), F.array(*[F.lit(f) for f in fields]).alias("present"))
    return upsert(current, updates, "event", "seq")


def choose_feed(primary: DataFrame, minimal: DataFrame, recovered: DataFrame, standings: DataFrame, daily: DataFrame,
                meta: DataFrame) -> DataFrame:
    """Q9: matches of each event from its best feed.

    The primary items, completed by recovered items (only those J6 found missing) and by standings, answer where there
    is any primary item. Else the daily feed answers for a numeric event whose source or name is of the legacy kind, or
    that has no known source date.
    """
    missing = missing_codes(minimal, primary, EVENT, feed_code(), knockout_code(F.col("code")), "seq")
    live = primary.select("event").distinct()
    # normalised before any shuffle: what travels are matches and flat facts, not cards
    found = join_on(normalize_feed(recovered, for_merge=True), missing.select("event", F.col("code").alias("m_code")),
                    ["event", "m_code"], "left_semi")
    complete = recover(normalize_feed(primary, for_merge=True), join_on(found, live, EVENT, "left_semi"))
    complete = complete.withColumnRenamed("merged_seq", "place")
    ties = join_on(standings, live, EVENT, "left_semi").withColumns(
        {"m_match": F.lit(True), "place": F.struct(F.lit(0).alias("origin"), F.col("seq").alias("seq"))})
    full = supplement(complete, ties, "place").filter("m_match")
    # the order is a place in each merge, whatever the positions are; in the result it is the row's number
    order = {"__supplement": F.col("merged_seq.origin"), "__recovered": F.col("merged_seq.seq.origin"),
             "__position": F.col("merged_seq.seq.seq")}
    full = full.withColumns(order).withColumn("__chunk", F.floor(F.col("__position") / F.lit(65536)))
    # numbering reads its rows twice: the merge of both feeds is done once
    full = number_rows(written(full.select(*EVENT, *MATCH_COLUMNS, *order, "__chunk")), Scope(EVENT, ["__supplement", "__recovered", "__chunk"], list(order)), "seq")
    source = F.lower(trim(F.col("source")))
    dated = (text(F.col("startDate")) != "") | (text(F.col("endDate")) != "")
    allowed = meta.filter(F.col("event").rlike(r"^\d+$") & (
        source.isin(fixed.LEGACY_FEED_SOURCES) | results_preferred_name(first_text(F.col("title")))
        | ~((source == fixed.CALENDAR_SOURCE) | dated)))
    fallback = join_on(join_on(daily, live, EVENT, "left_anti"), allowed.select("event"), EVENT, "left_semi")
    columns = ["event", "seq", *MATCH_COLUMNS]
    return full.select(*columns).unionByName(fallback.select(*columns))
