import json

import pytest
from pyspark.sql import functions as F

from courtside.operators import filters, report, stages
from courtside.operators import index as ix
from courtside.operators.filters import MatchArgs
from courtside.operators.lookup import translate_matches
from courtside.plans import jobs
from courtside.schema import ARCHIVE_INDEX, DATE_INDEX, SEARCH_INDEX
from courtside.sources import files
from courtside.sources.index import (
    LabelRules, read_dictionary, read_event_names, read_keyed_index, read_label_rules, write_sorted_index,
)
from tests import fixtures as fx

ANN, BO, CY, DI = (fx.person(n, o) for n, o in (("Ann Lee", "AAA"), ("Bo Kim", "BBB"), ("Cy Ray", "AAA"), ("Di Sun", "BBB")))


def lines(df, event="1"):
    rows = df.filter(F.col("event") == event).orderBy("row_no", "line_no").collect()
    return "\n".join(r["line"] for r in rows)


def tie(seq, rubbers, score="2-1", **fields):
    singles = [{"order": i + 1, "overallScore": s, "gameScores": g, "competitors": [fx.competitor(h, kind=k[0]), fx.competitor(a, kind=k[1])],
                "resultStatus": None} for i, (h, a, s, g, k) in enumerate((*r, ("H", "A"))[:5] for r in rubbers)]
    return fx.match(seq, matchType="team", categoryName="Men Teams", discipline="teams", gender=fields.pop("gender", "men"), overallScore=score,
                    teams=[{"name": "Alphas 1", "org": "AAA"}, {"name": "Betas", "org": "BBB"}], singles=singles, **fields)


THREE = [(ANN, BO, "3-0", ["11-1", "11-2", "11-3"]), (CY, DI, "1-3", ["11-7", "7-11", "5-11", "9-11"]), (fx.person("Ed Fox", "AAA"), fx.person("Gil Orr", "BBB"), "3-2", [])]


@pytest.fixture(scope="module")
def rows(spark):
    return fx.matches(spark, [
        fx.match(0, documentCode="B", categoryName="Men Singles", roundKey="final", roundLabel="Finals", matchNumber=2, description="Men Singles - Finals - Match 2",
                 overallScore="1-3", gameScores=["11-7", "7-11", "5-11", "9-11"], competitors=[fx.competitor(ANN), fx.competitor(BO)]),
        fx.match(1, documentCode="A", categoryName="Men Singles", roundKey="round_of_16", roundLabel="Round of 16", matchNumber=1, description="Men Singles - Round of 16 - Match 1",
                 overallScore="0-0", competitors=[fx.competitor(CY), fx.competitor(DI)]),
        fx.match(2, documentCode="P", categoryName="Men Singles Class 3", isParaClass=True, overallScore="3-0"),
        fx.match(3, documentCode="D", categoryName="Mixed Doubles", gender="mixed", discipline="mixed", roundKey="final", roundLabel="Finals", overallScore="W-L",
                 description="x", competitors=[fx.competitor(ANN, BO), fx.competitor(CY, DI)]),
        tie(4, THREE, documentCode="T", roundKey="group 2", roundLabel="Group 2", description="Men Teams - Group 2"),
        fx.match(0, event="2", documentCode="Z", categoryName="U19 Boys Singles", roundKey="semifinal", roundLabel="Semifinals", overallScore="3-1",
                 gameScores=["11-9"], competitors=[fx.competitor(ANN), fx.competitor(BO)], description="U19 Boys Singles - Semifinals", resultStatus="Retired"),
    ])


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("players", "LEE Ann", "山田 花子"), ("players", "Bo Kim", "金"), ("teams", "AAA", "アルファ"), ("teams", "Betas", "ベータ"),
                                  ("rounds", "final", "決勝")], "kind string, key string, value string")


def test_native_report(rows, dictionary):
    out = jobs.match_query(rows, MatchArgs(), dictionary)
    assert lines(out) == "\n".join([
        "▼男子シングルス決勝トーナメント1回戦", "Cy Ray（アルファ）　-　Di Sun（BBB）", "",
        "▼男子シングルス決勝", "金（BBB）　3(-7,7,5,9)1　山田花子（アルファ）", "",
        "▼男子団体グループ2", "　アルファ　2-1　ベータ", "○山田花子　3(1,2,3)0　金", "　Cy Ray　1(7,-7,-5,-9)3　Di Sun○", "○Ed Fox　3()2　Gil Orr",
        "　山田花子　-　Di Sun", "　Cy Ray　-　金", "",
        "▼混合ダブルス決勝", "山田花子／金（アルファ／BBB）\n　不戦勝\n　　Cy Ray／Di Sun（アルファ／BBB）"])
    assert lines(out, "2") == "▼U19男子シングルス決勝トーナメント1回戦\nAnn Lee（AAA）　棄権　Bo Kim（BBB）".replace("Ann Lee（AAA）", "山田花子（アルファ）").replace("Bo Kim", "金")


def test_english_report(rows):
    out = jobs.match_query(rows, MatchArgs(mode="en", category="Men Singles", omit_sets=True))
    assert lines(out) == "▼Men's Singles Round of 16\nCy Ray (AAA) - Di Sun (BBB)\n\n▼Men's Singles Final\nBo Kim (BBB) d. Ann Lee (AAA) -7,7,5,9"
    tied = lines(jobs.match_query(rows, MatchArgs(mode="en", discipline="teams")))
    assert tied == "\n".join(["▼Men's Teams Group 2", "  AAA 2-1 BBB", "  Ann Lee d. Bo Kim 3(1,2,3)0", "  Di Sun d. Cy Ray 3(-7,7,5,9)1",
                              "  Ed Fox d. Gil Orr 3()2", "  Ann Lee - Di Sun", "  Cy Ray - Bo Kim"])


def test_list_text_and_json(rows):
    assert lines(jobs.match_query(rows, MatchArgs(mode="list", limit=2))) == (
        "1. Men Singles - Finals - Match 2 | Ann Lee（AAA） 1-3 Bo Kim（BBB）\n2. Men Singles - Round of 16 - Match 1 | Cy Ray（AAA） 0-0 Di Sun（BBB）")
    assert lines(jobs.match_query(rows, MatchArgs(mode="text", code="T"))).startswith(
        "[1] Men Teams - Group 2\nAlphas 1 (AAA) 2-1 Betas (BBB)\n1. Ann Lee (AAA) vs Bo Kim (BBB) | 3-0 | 11-1, 11-2, 11-3")
    (row,) = jobs.match_query(rows, MatchArgs(mode="json", code="B")).collect()
    assert json.loads(row["line"])["gameScores"] == ["11-7", "7-11", "5-11", "9-11"] and json.loads(row["line"])["venue"] is None


def codes(df):
    return sorted(r["documentCode"] for r in df.collect())


def test_filters(rows, dictionary):
    def found(**args):
        return codes(jobs.match_rows(rows, MatchArgs(**args), dictionary))

    assert found() == ["A", "B", "D", "T", "Z"]
    assert found(category="men's singles") == ["A", "B"]
    assert found(category="Mixed Teams") == []
    assert found(category="mixed doubles") == ["D"]
    assert found(category="Women Singles") == []
    assert found(gender="male") == ["A", "B", "T", "Z"]
    assert found(rounds=("決勝",)) == ["B", "D"]
    assert found(rounds=("group", "semi finals")) == ["T", "Z"]
    assert found(gender="men", rounds=("第2回戦",)) == ["B"]
    assert found(contains="花子") == ["B", "D", "T", "Z"]
    assert found(contains="KIM bo") == ["B", "D", "T", "Z"]
    assert found(code="A") == ["A"] and found(limit=1) == ["B", "Z"]


def test_facets(rows):
    got = jobs.match_facets(rows, MatchArgs(category="Men Singles", gender="male"))
    assert [tuple(r) for r in got["summary"].orderBy("event").collect()] == [("1", 5, 2), ("2", 1, 1)]
    # facets compare the gender as given, so "male" finds no row
    assert got["categories"].count() == 0
    plain = jobs.match_facets(rows, MatchArgs())
    options = plain["categories"].filter("event = '1'").orderBy("sort_key").collect()
    assert [(r["value"], r["label"]) for r in options] == [("Men Singles", "男子シングルス"), ("Men Teams", "男子団体"), ("Mixed Doubles", "混合ダブルス")]
    rounds = plain["round_options"].filter("event = '1'").orderBy("sort_value").collect()
    assert [(r["value"], r["label"], r["sort_value"]) for r in rounds] == [
        ("Group 2", "グループ2", 2), ("Round of 16", "決勝トーナメント1回戦", 101), ("Finals", "決勝トーナメント2回戦", 102)]


def pending(spark, rubbers, **fields):
    shown = report.with_display(fx.matches(spark, [tie(0, rubbers, **fields)]))
    return [(p["left"], p["right"]) for p in report._with_pending(shown).first()["pending"]]


def test_pending_pairs(spark):
    assert pending(spark, THREE) == [("Ann Lee", "Di Sun"), ("Cy Ray", "Bo Kim")]
    assert pending(spark, THREE, score="1-2") == [("Di Sun", "Ann Lee"), ("Bo Kim", "Cy Ray")]
    unplayed = [*THREE, (ANN, DI, "0-0", []), (CY, BO, "0-0", [])]
    assert pending(spark, unplayed) == []
    assert pending(spark, THREE[:2]) == [] and pending(spark, THREE, gender="mixed") == []


def test_pending_pairs_doubles_first(spark):
    singles = [{"order": 1, "overallScore": "3-0", "gameScores": [], "competitors": [fx.competitor(ANN, CY), fx.competitor(BO, DI)]},
               {"order": 2, "overallScore": "3-0", "gameScores": [], "competitors": [fx.competitor(fx.person("Ed", "AAA")), fx.competitor(fx.person("Gil", "BBB"))]},
               {"order": 3, "overallScore": "3-0", "gameScores": [], "competitors": [fx.competitor(ANN), fx.competitor(DI)]}]
    row = tie(0, [])
    row["singles"] = singles
    shown = report.with_display(fx.matches(spark, [row]))
    got = [(p["left"], p["right"]) for p in report._with_pending(shown).first()["pending"]]
    assert got == [("Cy Ray", "Gil"), ("Ed", "Bo Kim")]


def test_mixed_team_report(spark):
    out = jobs.match_query(fx.matches(spark, [tie(0, THREE, score="1-3", gender="mixed", roundKey="final", roundLabel="Finals")]), MatchArgs())
    assert lines(out) == "\n".join(["▼男子団体決勝トーナメント1回戦", "　Betas　【5-7】　Alphas 1", "【0】Bo Kim　-1,-2,-3　Ann Lee【3】",
                                    "【3】Di Sun　-7,7,5,9　Cy Ray【1】", "【2】Gil Orr　　Ed Fox【3】"])


def test_order_of_input_does_not_matter(rows, dictionary):
    a, b = (lines(jobs.match_query(rows.repartition(n), MatchArgs(), dictionary)) for n in (1, 7))
    assert a == b


def test_ranged_order_and_large_limit(spark, rows, dictionary):
    from courtside.operators.filters import limit_rows

    assert lines(jobs.match_query(rows, MatchArgs(), dictionary, ranged=True)) == lines(jobs.match_query(rows, MatchArgs(), dictionary))
    many = spark.range(0, 150000).select((F.col("id") % 3).alias("e"), F.col("id").alias("seq"))
    got = limit_rows(many, ["e"], ["seq"], 30000).groupBy("e").agg(F.count("*").alias("n"), F.max("seq").alias("m")).orderBy("e").collect()
    assert [tuple(r) for r in got] == [(0, 30000, 89997), (1, 30000, 89998), (2, 30000, 89999)]


# ---- indexes ---------------------------------------------------------------------------

def now():
    return F.lit("2026-03-08").cast("date")


BASES = ix.UrlBases("e?", "t?", "r/")


@pytest.fixture
def indexes(spark, tmp_path):
    archive = fx.write(tmp_path / "a.json", {"3001": {"title": "Alpha Open 2026", "startDate": "2026-03-01", "endDate": "2026-03-08", "source": "bornan", "archived": True},
                                             "3002": {"title": "Test event", "source": "calendar"}, "2600": {"title": "Old Cup", "startDate": "2020-01-01", "source": "calendar"}})
    search = fx.write(tmp_path / "s.json", {"3001": {"eventName": "Alpha Open", "endDate": "2026-03-09", "source": "wtt", "series": "Special"},
                                            "3003": {"eventName": "Team Smash 2027", "source": "calendar"}})
    dates = fx.write(tmp_path / "d.json", {"3001": {"endDate": None, "eventName": "Alpha Open X"}, "3004": {"startDate": "2026-05-01", "endDate": "2026-06-02"}})
    names = fx.write(tmp_path / "n.json", {"3004": "Stored Champions", "zennihon": {"2019": "第1回 大会", "2020": "第2回 大会"}})
    return (read_keyed_index(spark, archive, ARCHIVE_INDEX), read_keyed_index(spark, search, SEARCH_INDEX),
            read_keyed_index(spark, dates, DATE_INDEX), read_event_names(spark, names))


def test_search(spark, indexes):
    archive, search, dates, names = indexes
    events = jobs.searchable_events(archive, search, dates, names, now(), BASES)
    got = {r["event"]: r for r in events.collect()}
    assert set(got) == {"3001", "2600", "3003", "3004"}
    # the date index holds an explicit null end date, which wins
    one = got["3001"]
    assert (one["eventName"], one["endDate"], one["dateLabel"], one["status"], one["series"], one["archived"]) == ("Alpha Open X", None, "2026/3/1", "unknown", "Special", True)
    assert one["eventUrl"] == "r/TTE3001/results.html#/results" and got["3003"]["eventUrl"] == "t?3003" and got["2600"]["eventUrl"] == "r/2600/results.html#/results"
    assert got["3003"]["status"] == "upcoming" and got["3004"]["eventName"] == "Stored Champions" and got["3004"]["dateLabel"] == "2026/5/1-6/2"

    def found(q):
        return [r["event"] for r in jobs.event_search(events, q).collect()]

    assert found("") == ["2600", "3001", "3004", "3003"]
    assert found("open alpha") == ["3001"] and found("2026/5") == ["3004"] and found("2026/1") == [] and found("300") == ["3001", "3004", "3003"]
    extra = events.limit(1).withColumn("event", F.lit("77"))
    assert [r["event"] for r in jobs.event_search(events, "77", extra).collect()] == ["77"]
    meta = spark.createDataFrame([("2600", "2020-01-01", "2020-01-02", "2020/1/1-2", "finished"), ("3003", "2027-01-01", None, "2027/1/1", "upcoming")],
                                 "event string, startDate string, endDate string, dateLabel string, status string")
    assert [(r["event"], r["dateLabel"]) for r in jobs.event_search(events, "3003", meta=meta).collect()] == [("3003", "2027/1/1")]
    assert [(r["event"], r["dateLabel"]) for r in jobs.event_search(events, "2600", meta=meta).collect()] == [("2600", "2020/1/1")]
    own = jobs.domestic_search(names, "", "d/")
    assert [r["event"] for r in own.collect()] == ["2020", "2019"] and own.first()["status"] == "finished"


def test_build_index(spark, indexes, tmp_path):
    archive, search, dates, _ = indexes
    matches = fx.matches(spark, [fx.match(0, event="3003", categoryName="A", roundKey="final", resultStatus="OFFICIAL"), fx.match(0, event="3009")])
    meta = spark.createDataFrame([("3003", "Team Smash", None, None, False, False, "wtt"), ("3009", "Simulation", None, None, False, False, "wtt")],
                                 "event string, title string, startDate string, endDate string, isFinished boolean, archived boolean, source string")
    entries = jobs.verified_entries(matches, meta, spark.createDataFrame([], "event string, name string"), now(), "now")
    probed = spark.createDataFrame([("3001",), ("3003",), ("3009",)], "event string")
    shown = jobs.discovered_events(entries, BASES).first()
    assert (shown["event"], shown["eventUrl"], shown["status"]) == ("3003", "t?3003", "finished")
    built = jobs.build_event_index(probed, entries, archive, dates, search, now(), "now", str(tmp_path / "out"))
    got = {r["event"]: r for r in built.collect()}
    assert set(got) == {"3003", "3001", "2600"} and got["3003"]["status"] == "finished" and got["3003"]["series"] == "Smash"
    assert (got["3001"]["eventName"], got["3001"]["dateLabel"], got["3001"]["status"]) == ("Alpha Open X", "", "unknown")
    text = "".join(open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x)["event"] for x in text.splitlines()] == ["2600", "3001", "3003"]


def test_lifecycle_meta(spark, indexes):
    archive, _, dates, _ = indexes
    feed = ix.daily_meta(spark.createDataFrame([("3003", None, "Daily", False, [("",), ("2026-02-01",), ("2026-02-03",)], "bornan"), ("3009", "Live", None, False, [("2026-03-08",)], "x")],
                                               "event string, champDesc string, champ string, isFinished boolean, dates array<struct<raw:string>>, feed_source string"))
    events = spark.createDataFrame([("3001",), ("2600",), ("3003",), ("3009",), ("3010",)], "event string")
    got = {r["event"]: (r["mode"], r["isFinished"], r["startDate"], r["source"]) for r in ix.lifecycle_meta(events, dates, archive, feed, "2026-03-09").collect()}
    assert got["3001"] == ("archived", True, "2026-03-01", "bornan") and got["2600"] == ("live", False, "2020-01-01", "calendar")
    assert got["3003"] == ("finished", True, "2026-02-01", "bornan") and got["3010"] == ("live", False, None, "wtt") and got["3009"][0] == "finished"


def test_names_and_aliases(spark, indexes):
    _, search, dates, _ = indexes
    aliases = ix.alias_table(spark, {"10": "3003", "11": "3001"})
    events = spark.createDataFrame([("10",), ("11",), ("3001",), ("9",)], "event string")
    got = {r["event"]: r["indexed"] for r in ix.indexed_names(events, "event", aliases, search, dates).collect()}
    assert got == {"10": "Team Smash 2027", "11": "Alpha Open", "3001": "Alpha Open"}
    assert {r["event"]: r["out"] for r in ix.resolve_event_alias(events, "event", aliases, "out").collect()}["10"] == "3003"


def test_alignment(spark, rows):
    listed = spark.createDataFrame([("1", "Men Singles", "KO", 0), ("1", "Men Singles", "RR", 1), ("1", "Women Singles", "KO", 2), ("1", "", "x", 3)],
                                   "event string, subEventName string, subEventDrawTypeId string, seq int")
    diff, checked = jobs.alignment_check(listed, rows.filter("event = '1'"))
    assert {(r["categoryName"], r["side"]) for r in diff.collect()} == {("Women Singles", "left"), ("Men Teams", "right"), ("Mixed Doubles", "right")}
    got = {r["categoryName"]: (r["drawType"], r["matches"], r["rounds"], r["suspicious"]) for r in checked.collect()}
    assert got == {"Men Singles": ("KO", 2, 2, []), "Women Singles": ("KO", 0, 0, ["listed_but_no_matches"])}


def test_archive_events(spark, rows, indexes, tmp_path):
    archive = indexes[0].drop("present")
    meta = spark.createDataFrame([("1", "wtt", "One", "2026-01-01", "2026-01-02", True, False), ("2", "wtt", "Two", None, None, False, False)],
                                 "event string, source string, title string, startDate string, endDate string, isFinished boolean, canAutoArchive boolean")
    got = {r["event"]: r for r in jobs.archive_events(rows, meta, archive, str(tmp_path / "t"), "now").collect()}
    assert got["1"]["archived"] is True and "2" not in got and got["3001"]["title"] == "Alpha Open 2026"
    forced = {r["event"]: r["forced"] for r in jobs.archive_events(rows, meta, archive, str(tmp_path / "t"), "now", force=True).collect()}
    assert forced["1"] is False and forced["2"] is True


# ---- files and settings ----------------------------------------------------------------

def test_dictionary_and_rules(spark, tmp_path):
    path = fx.write(tmp_path / "d.json", {"teams": {"AAA": "A"}, "players": None, "rounds": {"final": "F"}})
    assert {tuple(r) for r in read_dictionary(spark, path).collect()} == {("teams", "AAA", "A"), ("rounds", "final", "F")}
    assert read_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    empty = fx.write(tmp_path / "e.json", {"rounds": {"final": "F"}})
    with pytest.raises(Exception, match="neither teams nor players"):
        read_dictionary(spark, empty, strict=True).collect()
    rules = read_label_rules(spark, fx.write(tmp_path / "r.json", {"labels": {"groupPrefix": "G", "knockoutPrefix": ""}}))
    assert (rules.group_prefix, rules.knockout_prefix, rules.round_fallbacks, rules.stage_display) == ("G", "決勝トーナメント", {}, {})
    assert read_label_rules(spark, str(tmp_path / "none.json")) == LabelRules()


def test_corrupt_index(spark, tmp_path):
    path = fx.write(tmp_path / "c.json", "{broken")
    assert read_keyed_index(spark, path, SEARCH_INDEX).count() == 0
    with pytest.raises(Exception):
        read_keyed_index(spark, path, SEARCH_INDEX, corrupt="raise").collect()


def test_manifest(spark, tmp_path):
    import hashlib

    for name in ("b.json", "a.json", "c.txt"):
        fx.write(tmp_path / "m" / name, name * 3)
    found = files.file_manifest(spark, [str(tmp_path / "m")], wanted=["a.json", "z.json"])
    got = {r["name"]: r for r in found.collect()}
    assert got["a.json"]["sha256"] == hashlib.sha256(b"a.json" * 3).hexdigest() and got["a.json"]["size"] == 18
    assert got["z.json"]["exists"] is False and got["z.json"]["size"] == 0
    assert {r["event"] for r in files.latest_files(found.filter("exists"), 0).collect()} == {"a", "b"}
    assert tuple(files.file_counts(found).first()) == (2, 36) and files.find_file(found, " a ").count() == 1
    target = found.filter("name = 'a.json'").withColumn("mtime", F.col("mtime") - F.expr("interval 1 minute")).unionByName(found.filter("name = 'c.txt'"))
    source = found.filter("exists")
    assert {r["name"] for r in files.files_to_refresh(source, target).collect()} == {"a.json", "b.json"}
    assert {r["name"] for r in files.files_to_refresh(source, target, only_missing=True).collect()} == {"b.json"}


def test_sorted_index_and_report_files(spark, rows, tmp_path):
    write_sorted_index(spark.createDataFrame([("10",), ("9",), ("100",)], "event string"), str(tmp_path / "i"))
    text = "".join(open(p).read() for p in sorted((tmp_path / "i").glob("part-*")))
    assert [json.loads(x)["event"] for x in text.splitlines()] == ["9", "10", "100"]
    report.write_report(jobs.match_query(rows, MatchArgs(mode="list")), str(tmp_path / "r"))
    text = "".join(open(p).read() for p in sorted((tmp_path / "r" / "event=1").glob("part-*")))
    assert [x.split(".")[0] for x in text.splitlines()] == ["1", "2", "3", "4"]


def test_calendar_rows(spark):
    ddl = "EventCode string, EventId string, EventName string, EventDateChangeId string, ShowInCalendar boolean, StartDateTime string, EndDateTime string, FromStartDate string, FromEndDate string"
    rows = spark.createDataFrame([("0", "12", " A  B ", None, True, "2026-01-01T00:00", None, None, None), ("x", "y", "C", None, None, "2026-01-01", None, None, None),
                                  ("13", "1", "D", "5", True, "2026-01-01", "2026-01-02", "2026-02-01T", None), ("14", "", "E", None, None, "soon", None, None, None)], ddl)
    assert [tuple(r)[:4] for r in ix.normalize_calendar_row(rows).collect()] == [("12", "A B", "2026-01-01", None), ("13", "D", "2026-02-01", None)]


def test_generic_category_keeps_a_scope_without_it(spark):
    rows = fx.matches(spark, [fx.match(0, event="1", categoryName="Men Singles"), fx.match(1, event="1", categoryName="Women Singles"),
                              fx.match(0, event="2", categoryName="Women Singles", documentCode="x")])
    kept = filters.filter_category(rows, ["event"], "Men Singles")
    assert {(r["event"], r["categoryName"]) for r in kept.collect()} == {("1", "Men Singles"), ("2", "Women Singles")}
    assert filters.filter_category(rows, ["event"], "U19 Boys Singles").count() == 0


def test_missing_details_come_from_the_archive(spark):
    from courtside.operators.merge import enrich_missing_details

    bare = fx.matches(spark, [tie(0, [], documentCode="A--", venue="", table="T9"), tie(1, THREE[:1], documentCode="B"), tie(2, [], documentCode=None)])
    old = fx.matches(spark, [tie(0, THREE, documentCode="A", venue="Hall", table="T1"), tie(1, THREE, documentCode="B", venue="Hall")])
    got = {r["seq"]: (r["venue"], r["table"], len(r["singles"])) for r in enrich_missing_details(bare, old).collect()}
    assert got == {0: ("Hall", "T9", 3), 1: (None, None, 1), 2: (None, None, 0)}


def test_translated_maps(rows, dictionary):
    got = {r["documentCode"]: r for r in translate_matches(rows, dictionary).collect()}
    assert got["B"]["player_names"] == {"Ann Lee": "山田花子", "Bo Kim": "金"} and got["T"]["team_names"] == {"AAA": "アルファ", "Betas": "ベータ"}
    assert got["A"]["player_names"] is None and got["B"]["round_translated"] == "決勝"


def test_render_context_ignores_round_filter(rows):
    got = stages.number_knockout_rounds(rows.filter("documentCode = 'B'"), ["event"], context=rows).first()
    assert got["stage_number"] == 2
