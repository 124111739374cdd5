"""Event indexes: calendar rows, aliases, names, urls, merging, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside import fixed
from courtside.functions.dates import date_only, date_range_label, ended_before, lifecycle_status
from courtside.functions.labels import hosted_name, indexable_name, results_preferred_name, series, team_event_name
from courtside.functions.text import blank_to_null, collapse, first_text, norm_source, text, trim
from courtside.operators.keys import lookup


def normalize_calendar_row(rows: DataFrame, updated_at: str | None = None) -> DataFrame:
    """P15."""
    code, own = trim(F.col("EventCode")), trim(F.col("EventId"))
    numeric = code.rlike(r"^\d+$") & ~code.rlike("^0+$")
    moved = (text(F.col("EventDateChangeId")) != "") & ~F.col("EventDateChangeId").isin("0", "false") & F.coalesce(
        "ShowInCalendar", F.lit(False))
    out = rows.select(
        F.when(numeric, code).otherwise(own).alias("event"), trim(collapse(F.col("EventName"))).alias("eventName"),
        date_only(F.when(moved, F.col("FromStartDate")).otherwise(F.col("StartDateTime"))).alias("startDate"),
        date_only(F.when(moved, F.col("FromEndDate")).otherwise(F.col("EndDateTime"))).alias("endDate"),
        F.lit(fixed.CALENDAR_SOURCE).alias("source"), F.lit(updated_at).cast("string").alias("updatedAt"),
        *[c for c in rows.columns if c == "seq"])
    return out.filter(F.col("event").rlike(r"^\d+$") & (F.col("eventName") != "")
                      & (F.col("startDate").isNotNull() | F.col("endDate").isNotNull()))


def normalize_date_entry(rows: DataFrame, updated_at: str | None = None) -> DataFrame:
    """Rows with any of the three spellings of start, end and name; missing columns are read as blank."""
    def any_of(*names):
        have = [F.col(n) for n in names if n in rows.columns]
        return trim(first_text(*have)) if have else F.lit("")

    event = any_of("eventId", "event", "EventId")
    return rows.select(
        event.alias("event"), any_of("eventName", "EventName", "title").alias("eventName"),
        blank_to_null(any_of("startDate", "StartDateTime", "start")).alias("startDate"),
        blank_to_null(any_of("endDate", "EndDateTime", "end")).alias("endDate"),
        F.coalesce(blank_to_null(any_of("source")), F.lit(fixed.CALENDAR_SOURCE)).alias("source"),
        F.lit(updated_at).cast("string").alias("updatedAt"), *[c for c in rows.columns if c == "seq"],
    ).filter(F.col("event") != "")


def alias_table(spark, aliases: dict[str, str] | None = None) -> DataFrame:
    values = fixed.EVENT_ALIASES if aliases is None else aliases
    return spark.createDataFrame(list(values.items()), "alias string, canonical string")


def resolve_event_alias(df: DataFrame, event: str, aliases: DataFrame, out: str, source: Column | None = None
                        ) -> DataFrame:
    """Alias id to canonical id, for the default source only."""
    found = lookup(df, aliases.select(F.col("alias").alias(event), F.col("canonical").alias("__canonical")), [event])
    applies = F.lit(True) if source is None else norm_source(source) == fixed.DEFAULT_SOURCE
    return found.withColumn(out, F.when(applies, F.coalesce("__canonical", F.col(event))).otherwise(F.col(event))
                            ).drop("__canonical")


def related_ids(df: DataFrame, event: str, aliases: DataFrame) -> DataFrame:
    """(event, related, position): the id itself, then both ends of every alias that touches it."""
    ends = aliases.select(F.explode(F.array(
        F.struct(F.col("alias").alias("touch"), F.array("alias", "canonical").alias("ids")),
        F.struct(F.col("canonical").alias("touch"), F.array("alias", "canonical").alias("ids")))).alias("e"))
    ends = ends.select(F.col("e.touch").alias(event), F.col("e.ids").alias("ids"))
    own = df.select(event).distinct()
    pairs = (own.select(event, F.col(event).alias("related"), F.lit(0).alias("position"))
             .unionByName(lookup(own, ends, [event], "inner").select(
                 event, F.posexplode("ids").alias("p", "related")).select(event, "related", (F.col("p") + 1)
                                                                          .alias("position"))))
    return pairs.groupBy(event, "related").agg(F.min("position").alias("position"))


@dataclass(frozen=True)
class UrlBases:
    """Where public pages live. The engine knows no address; the caller names them."""

    event: str
    team_event: str
    results: str
    results_suffix: str = "/results.html#/results"
    legacy_prefix: str = "TTE"


def url_part(c: Column) -> Column:
    return F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20"))


def event_url(event: Column, source: Column, name: Column, bases: UrlBases, override: Column | None = None) -> Column:
    """Override, then results site for old ids, results site for legacy events, team page, default page."""
    number = F.when(event.rlike(r"^\d+$"), event.try_cast("bigint"))
    hosted = hosted_name(name)
    legacy = F.lower(trim(source)).isin(fixed.LEGACY_URL_SOURCES) | results_preferred_name(name)
    chain = (F.when(trim(event) == "", "")
             .when((number < fixed.MIN_REMOTE_NAMED_EVENT) & ~hosted,
                   F.concat(F.lit(bases.results), url_part(event), F.lit(bases.results_suffix)))
             .when(legacy & ~hosted, F.concat(F.lit(bases.results + bases.legacy_prefix), url_part(event),
                                              F.lit(bases.results_suffix)))
             .when(team_event_name(name), F.concat(F.lit(bases.team_event), url_part(event)))
             .otherwise(F.concat(F.lit(bases.event), url_part(event))))
    return chain if override is None else F.coalesce(override, chain)


def first_name(payload: DataFrame, event: Sequence[str], fields: Sequence[str], seq: str) -> DataFrame:
    """First non-blank name of an event's rows, in order; inside a row the first non-empty of ``fields``."""
    named = payload.withColumn("__name", trim(first_text(*[F.col(f) for f in fields])))
    return named.groupBy(*event).agg(F.min_by("__name", F.when(F.col("__name") != "", F.col(seq))).alias("name"))


def resolved_name(event: Column, stored: Column, indexed: Column, remote: Column) -> Column:
    """An old id keeps its stored or indexed name; others take the remote one first."""
    local = first_text(stored, indexed)
    old = event.rlike(r"^\d+$") & (event.try_cast("bigint") < fixed.MIN_REMOTE_NAMED_EVENT)
    return F.coalesce(F.when(old, local), blank_to_null(remote), local, F.lit(""))


def indexed_names(events: DataFrame, event: str, aliases: DataFrame, search: DataFrame, dates: DataFrame) -> DataFrame:
    """Name from the search index, then from the date index, trying related ids in order."""
    related = related_ids(events, event, aliases)
    names = (search.select(F.col("event").alias("related"), F.lit(0).alias("index"), F.col("eventName").alias("name"))
             .unionByName(dates.select(F.col("event").alias("related"), F.lit(1).alias("index"),
                                       first_text(F.col("eventName"), F.col("title")).alias("name")))
             .filter(text(F.col("name")) != ""))
    hits = lookup(related, names, ["related"], "inner")
    return hits.groupBy(event).agg(F.min_by("name", F.struct("position", "index")).alias("indexed"))


def merge_event_indexes(archive: DataFrame, search: DataFrame, dates: DataFrame, key: str,
                        fields: Sequence[str], present: str | None = None) -> DataFrame:
    """One row per key of three indexes; per field dates win over search, search over archive.

    With ``present`` (name of an ``array<string>`` column of the fields a row carries) an explicit null wins as well.
    ``source`` follows its own rule: archive unless "calendar", then search, then archive, then the field rule.
    """
    def packed(df, alias):
        value = F.struct(*[(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields],
                         (F.col(present) if present else F.filter(F.array(*[
                             F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields if f in df.columns]),
                             lambda x: x.isNotNull())).alias("__has"))
        return df.select(F.col(key), value.alias(alias))

    joined = (packed(archive, "a").join(packed(search, "s"), key, "full_outer")
              .join(packed(dates, "d"), key, "full_outer"))

    def field(f):
        def has(side):
            return F.coalesce(F.array_contains(f"{side}.__has", f), F.lit(False))

        return (F.when(has("d"), F.col(f"d.{f}")).when(has("s"), F.col(f"s.{f}")).when(has("a"), F.col(f"a.{f}")))

    out = []
    for f in fields:
        value = field(f)
        if f == "source":
            a, s = blank_to_null(F.col("a.source")), blank_to_null(F.col("s.source"))
            value = F.coalesce(F.when(a != fixed.CALENDAR_SOURCE, a), s, a, value)
        out.append(value.alias(f))
    return joined.select(key, *out)


def _indexable(event: Column, name: Column) -> Column:
    return (event.try_cast("double") >= fixed.MIN_INDEXED_EVENT) & indexable_name(name)


def _merge_into(index: DataFrame, update: DataFrame, from_archive: bool, now: Column, verified_at: str) -> DataFrame:
    name = trim(first_text(*[F.col(c) for c in ("eventName", "title") if c in update.columns]))
    usable = update.withColumn("__name", name).filter(_indexable(trim(F.col("event")), F.col("__name")))
    u = usable.select(trim(F.col("event")).alias("event"), F.struct(*[c for c in usable.columns if c != "event"]).alias("u"))
    i = index.select("event", F.struct(*[c for c in index.columns if c != "event"]).alias("i"))
    joined = i.join(u, "event", "full_outer")
    new_start = first_text(F.col("u.startDate"), F.col("i.startDate"))
    new_end = first_text(F.col("u.endDate"), F.col("i.endDate"))
    known = F.coalesce(blank_to_null(F.col("i.status")), F.lit("unknown"))
    if from_archive:
        label_start, label_end = new_start, new_end
        fallback = F.when(F.coalesce("u.archived", F.lit(False)), "finished").otherwise(known)
        archived = F.coalesce("u.archived", "i.archived", F.lit(False))
        verified = first_text(F.col("i.verifiedAt"), F.col("u.archivedAt"), F.col("u.lastFetchedAt"))
        source = F.coalesce(first_text(F.col("i.source"), F.col("u.source")), F.lit(fixed.DEFAULT_SOURCE))
    else:
        # the date index labels and dates the status by its own dates alone
        label_start, label_end = blank_to_null(F.col("u.startDate")), blank_to_null(F.col("u.endDate"))
        fallback = known
        archived = F.coalesce("i.archived", F.lit(False))
        verified = first_text(F.col("i.verifiedAt"))
        source = F.coalesce(first_text(F.col("i.source"), F.col("u.source")), F.lit(fixed.CALENDAR_SOURCE))
    merged = {
        "eventName": F.col("u.__name"), "startDate": new_start, "endDate": new_end,
        "dateLabel": date_range_label(label_start, label_end), "archived": archived,
        "status": lifecycle_status(label_start, label_end, fallback, F.col("u.__name"), now), "source": source,
        "series": series(F.col("u.__name")), "verifiedAt": F.coalesce(verified, F.lit(verified_at)),
    }
    touched = F.col("u").isNotNull()
    return joined.select("event", *[
        (F.when(touched, merged[c]).otherwise(F.col(f"i.{c}")) if c in merged else F.col(f"i.{c}")).alias(c)
        for c in index.columns if c != "event"])


def merge_archive_into_index(index: DataFrame, archive: DataFrame, now: Column, verified_at: str) -> DataFrame:
    """J5, archive variant."""
    return _merge_into(index, archive, True, now, verified_at)


def merge_dates_into_index(index: DataFrame, dates: DataFrame, now: Column, verified_at: str) -> DataFrame:
    """J5, date variant."""
    return _merge_into(index, dates, False, now, verified_at)


def daily_meta(champs: DataFrame) -> DataFrame:
    """First and last date (by position) and the finished flag of the daily feed's event descriptions."""
    raw = F.filter(F.transform(F.coalesce("dates", F.array().cast("array<struct<raw:string>>")),
                               lambda d: text(d["raw"])), lambda d: d != "")
    return champs.select(
        "event", text(first_text(F.col("champDesc"), F.col("champ"))).alias("title"),
        F.get(raw, F.lit(0)).alias("startDate"), F.get(raw, F.size(raw) - 1).alias("endDate"),
        F.coalesce("isFinished", F.lit(False)).alias("isFinished"), F.col("feed_source").alias("source"))


def lifecycle_meta(events: DataFrame, dates: DataFrame, archive: DataFrame, feed: DataFrame, today: str) -> DataFrame:
    """Source, title, dates, finished flag and mode of each event; archive fields win over date fields.

    Where ``archive`` or ``dates`` has a column ``present`` (``array<string>``, the fields a row carries) a field it
    names wins even when it is null; without that column a null field counts as absent. ``feed`` is ``daily_meta``
    output.
    """
    def packed(df, alias, columns):
        return df.select("event", F.struct(*[c for c in columns if c in df.columns]).alias(alias))

    a_cols = ["source", "title", "startDate", "endDate", "archived", "forced", "canAutoArchive", "eventName", "present"]
    d_cols = ["source", "title", "eventName", "startDate", "endDate", "present"]
    joined = lookup(events.select("event").distinct(), packed(archive, "a", a_cols), ["event"])
    joined = lookup(joined, packed(dates, "d", d_cols), ["event"])
    joined = lookup(joined, packed(feed, "f", ["source", "title", "startDate", "endDate", "isFinished"]), ["event"])
    day = F.lit(today)

    def merged(c):
        sides = [(s, df) for s, df in (("a", archive), ("d", dates)) if c in df.columns]
        value = F.lit(None).cast("string")
        for s, df in reversed(sides):
            carried = (F.coalesce(F.array_contains(f"{s}.present", c), F.lit(False)) if "present" in df.columns
                       else F.col(f"{s}.{c}").isNotNull())
            value = F.when(carried, F.col(f"{s}.{c}")).otherwise(value)
        return value

    finished = ended_before(merged("endDate"), day)
    archived = F.coalesce("a.archived", F.lit(False)) & ~F.coalesce("a.forced", F.lit(False)) & finished
    undated = (text(merged("startDate")) == "") & (text(merged("endDate")) == "")
    by_feed = undated & F.col("event").rlike(r"^\d+$") & F.col("f").isNotNull() & ~finished
    feed_done = F.coalesce("f.isFinished", F.lit(False)) | F.coalesce(F.col("f.endDate") < day, F.lit(False))
    title = F.coalesce(blank_to_null(merged("title")), blank_to_null(merged("eventName")), F.lit(""))
    return joined.select(
        "event",
        F.when(by_feed, F.col("f.source")).otherwise(
            F.coalesce(blank_to_null(merged("source")), F.lit(fixed.DEFAULT_SOURCE))).alias("source"),
        F.when(by_feed, F.col("f.title")).when(archived, text(merged("title"))).otherwise(title).alias("title"),
        blank_to_null(F.when(by_feed, F.col("f.startDate")).otherwise(merged("startDate"))).alias("startDate"),
        blank_to_null(F.when(by_feed, F.col("f.endDate")).otherwise(merged("endDate"))).alias("endDate"),
        (finished | (by_feed & feed_done)).alias("isFinished"),
        F.when(by_feed, True).when(finished, F.coalesce("a.canAutoArchive", F.lit(False))).otherwise(False)
         .alias("canAutoArchive"),
        archived.alias("archived"),
        F.when(archived, "archived").when(finished | (by_feed & feed_done), "finished").otherwise("live").alias("mode"))
