import json
import random

from pyspark.sql import functions as F

from courtside import schema
from courtside.operators import html_pages, normalize
from courtside.operators.merge import merge_recovered, merge_supplemental
from courtside.plans import jobs
from courtside.sources import archive
from tests import fixtures as fx


def frame(spark, rows, ddl):
    df = spark.createDataFrame([(e, i, json.dumps(r, ensure_ascii=False)) for i, (e, r) in enumerate(rows)],
                               "event string, seq bigint, j string")
    return df.select("event", "seq", F.from_json("j", ddl).alias("r")).select("event", "seq", "r.*")


def by_code(df):
    return {r["documentCode"]: r.asDict(recursive=True) for r in df.collect()}


def test_archive_holds_items_and_matches(spark, tmp_path):
    fx.write(tmp_path / "a" / "9001.json", [
        fx.single_item("MS1", "Men's Singles - Round of 16 - Match 3"),
        fx.single_item("PA1", "x", category="Men's Singles Class 3"),
        fx.team_item("WT1", "Women's Teams - Group 2 - Match 4", [fx.rubber("Ann Lee", "Bo Kim"), fx.rubber("Cy", "Di", "1-3", True, "matchResult")]),
        fx.team_item("XX1", "Odd - Group 2", [], category="Relay"),
        {"documentCode": "none"}])
    fx.write(tmp_path / "a" / "2587.json", json.dumps([
        {"matchType": "team", "categoryName": "Men Teams", "competitors": [], "roundKey": "final", "teams": [{"name": "A", "org": "AAA"}],
         "singles": [{"order": 1, "overallScore": "0-0", "competitors": [{"name": "A", "org": "AAA", "players": [{"name": ""}]}]}]}], indent=1))
    rows = archive.read_match_archive(spark, str(tmp_path / "a")).collect()
    assert len(rows) == 4
    got = {(r["event"], r["documentCode"]): r.asDict(recursive=True) for r in rows}
    one = got[("9001", "MS1")]
    assert (one["matchType"], one["categoryName"], one["gender"], one["discipline"]) == ("individual", "Men Singles", "men", "singles")
    assert (one["roundLabel"], one["roundKey"], one["matchNumber"]) == ("Round of 16", "round_of_16", 3)
    assert one["gameScores"] == ["11-7", "7-11", "11-5", "11-8"] and one["competitors"][1]["players"][0]["orgCode"] == "BBB"
    assert got[("9001", "PA1")]["isParaClass"] is True
    tie = got[("9001", "WT1")]
    assert tie["teams"] == [{"name": "Alphas 1", "org": "AAA", "orgCode": None}, {"name": "Betas", "org": "BBB", "orgCode": None}]
    assert (tie["venue"], tie["table"], tie["resultStatus"], tie["roundKey"]) == ("Hall", "T1", "F", "group 2")
    assert [s["winnerOrg"] for s in tie["singles"]] == ["AAA", "BBB"]
    assert tie["singles"][1]["competitors"][0]["name"] == "Cy" and tie["singles"][0]["order"] == 1
    assert "202603051430" in tie["searchDateTokens"] and tie["competitors"] == []
    ready = got[("2587", None)]
    assert ready["roundKey"] == "final" and ready["singles"][0]["competitors"][0]["players"][0]["name"] == ""
    assert archive.read_match_archive(spark, str(tmp_path / "missing")).count() == 0


def test_archive_round_trip_replaces_only_its_events(spark, tmp_path):
    path = str(tmp_path / "table")
    old = fx.matches(spark, [fx.match(0, event="1", documentCode="A", source="wtt"), fx.match(0, event="2", documentCode="B", source="wtt")])
    archive.write_match_archive(old, path)
    archive.write_match_archive(fx.matches(spark, [fx.match(0, event="2", documentCode="C", source="wtt")]), path)
    got = archive.read_match_table(spark, path)
    assert sorted((r["event"], r["documentCode"]) for r in got.collect()) == [("1", "A"), ("2", "C")]


def daily_side(name, org, res, splits=(), members=(), win=None):
    return {"Org": org, "Desc": name, "Reg": name, "Res": res, "Win": win, "Splits": [{"Res": s} for s in splits],
            "Members": [{"Reg": m, "Desc": m, "Org": org} for m in members]}


def test_daily_feed(spark):
    items = frame(spark, [
        ("7", {"Key": "MS.1.QFNL.1", "Desc": "Men's Singles - Quarters - Match 4", "Home": daily_side("Ann Lee", "AAA", "3", ["11", "9"]),
               "Away": daily_side("Bo Kim", "BBB", None, ["7"]), "Status": " ", "Loc": "T2"}),
        ("7", {"Key": "MS.1.QFNL.2", "Home": daily_side("X", "BYE", "0"), "Away": daily_side("Y", "BBB", "0")}),
        ("7", {"Key": "WT.1.GP03.1", "IsTeam": True, "Home": daily_side("", "AAA", "3", members=["P", "Q"]), "Away": daily_side("Betas", "BBB", "1"),
               "SubMatches": [{"Home": daily_side("P", "AAA", "3", win=True), "Away": daily_side("R", "BBB", "0")}]}),
        ("7", {"Key": "MS.1.QFNL.1", "Desc": "Men's Singles - Quarters - Match 5", "Home": daily_side("Late", "AAA", "1"), "Away": daily_side("Z", "BBB", "3")}),
        ("7", {"Key": "", "Home": daily_side("U", "AAA", "1"), "Away": daily_side("V", "BBB", "3")})], ", ".join([schema.DAILY_ITEM]))
    descriptions = spark.createDataFrame([("7", "WT.1", "Old", 0), ("7", "WT.1", "Women's Teams", 1)],
                                         "event string, event_key string, description string, position int")
    plain = by_code(normalize.normalize_daily_feed(items.filter("seq < 3"), descriptions))
    one = plain["MS.1.QFNL.1"]
    assert (one["categoryName"], one["roundLabel"], one["overallScore"], one["gameScores"]) == ("Men Singles", "Quarters", "3-0", ["11-7", "9-0"])
    assert one["resultStatus"] is None and one["table"] == "T2" and one["competitors"][0]["type"] == "player" and one["competitors"][0]["org"] == "AAA"
    tie = plain["WT.1.GP03.1"]
    assert (tie["categoryName"], tie["roundLabel"], tie["roundKey"], tie["description"]) == ("Women Teams", "Group 3", "group 3", "Women's Teams - Group 3")
    assert tie["teams"][0] == {"name": "P / Q", "org": "AAA", "orgCode": "AAA"} and tie["singles"][0]["winnerOrg"] == "AAA"
    assert set(plain) == {"MS.1.QFNL.1", "WT.1.GP03.1"}
    kept = normalize.daily_feed_to_matches(items, descriptions)
    assert {(r["documentCode"], r["seq"], r["matchNumber"]) for r in kept.collect()} == {("MS.1.QFNL.1", 0, 5), ("WT.1.GP03.1", 2, None)}


def block(teams):
    return {"MessagePayload": {"Competition": {
        "ExtendedInfos": {"SportDescription": {"EventName": "Men's Teams"}, "VenueDescription": {"VenueName": "Hall"}},
        "Result": [{"Competitor": {"Organization": org, "Description": {"TeamName": org + " team"}, "Opponent": opponents}} for org, opponents in teams]}}}


def opponent(org, unit="MTGP030007--", result="3-1", date="2026-03-05", time="9:05"):
    return {"Unit": unit, "Organization": org, "Result": result, "Date": date, "Time": time, "Description": {"IfId": org + "-id"}}


def test_standings_are_folded_once(spark):
    """Places are numbered on the keys: whole rows are picked once, and the blocks are read three times, not four."""
    blocks = frame(spark, [("7", block([("AAA", [opponent("BBB")])]))], schema.STANDINGS_BLOCK).withColumn("page", F.lit(0))
    plan = normalize.explode_standings(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 3 * 2


def test_standings_fold_keeps_order(spark):
    rows = [("7", block([("AAA", [opponent("BBB", time=""), opponent("CCC", unit="")]), ("BBB", [opponent("AAA", result="0-0")])]))]
    blocks = frame(spark, rows, schema.STANDINGS_BLOCK).withColumn("page", F.lit(0))
    (m,) = normalize.explode_standings(blocks).collect()
    # the untimed real score came first; the timed 0-0 replaces it
    assert (m["overallScore"], m["resultStatus"], m["startDateLocal"]) == ("0-0", "0", "03/05/2026 09:05:00")
    assert (m["roundKey"], m["matchNumber"], m["documentCode"]) == ("group 3", 7, "MTGP030007--")
    assert [t["name"] for t in m["teams"]] == ["BBB team", "AAA-id"] and m["categoryName"] == "Men Teams"
    assert m["description"] == "Men's Teams - Group 3 - Match 7"


def test_standings_in_passes_are_those_of_one_plan(spark):
    """Events of several passes, an event without a name, units that are met again in later blocks, and an empty pass."""
    rng, rows = random.Random(4), []
    for event in ("7", "8", "9", None):
        for _ in range(8):
            teams = [(org, [opponent(rng.choice("XY") * 3, unit=f"MTGP030{rng.randrange(4):03}--", result=rng.choice(["0-0", "3-1", "2-3"]),
                                     time=rng.choice(["", "9:05"])) for _ in range(3)]) for org in ("AAA", "BBB")]
            rows.append((event, block(teams)))
    blocks = frame(spark, rows, schema.STANDINGS_BLOCK).withColumn("page", F.lit(0))
    one = normalize.explode_standings(blocks)
    columns = [F.to_json(F.struct(*one.columns)).alias("row")]
    expected = sorted(r["row"] for r in one.select(*columns).collect())
    cut = normalize.explode_standings(blocks, passes=5)
    assert sorted(r["row"] for r in cut.select(*columns).collect()) == expected and len(expected) == 16
    assert "posexplode" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert normalize.explode_standings(blocks.limit(0), passes=2).count() == 0


def test_fold_and_pick_share_a_shuffle(spark):
    from courtside.operators.merge import dedupe_fold

    rows = spark.range(50).select((F.col("id") % 5).cast("string").alias("a"), F.expr("nullif(id % 3, 2)").alias("b"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dedupe_fold(rows, ["a", "b"], ["id"], F.col("id") % 2 == 0, F.col("id") % 7 > 3)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.columns == ["a", "b", "id", "first_position"] and kept.count() == 15
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_html_tables(spark):
    html = (fx.page("男子シングルス", "１回戦", "MS+MS101", 101, [("Alpha&nbsp;One", "Club A(Pref A)")], [("Beta Two", "Club B")])
            + fx.page("混合ダブルス", "", "XD+XD202", 202, [("A<br>B", "C1"), ("D", "C2")], [("E", "C3"), ("F", "C3")], winner="")
            + '<table class="game">broken</table>')
    pages = spark.createDataFrame([("2024", 1, html)], "event string, page_id bigint, html string")
    got = by_code(html_pages.html_tables_to_matches(pages))
    one = got["MS+MS101"]
    assert (one["categoryName"], one["roundKey"], one["matchNumber"], one["overallScore"]) == ("Men Singles", "knockout_round_1", 101, "3-1")
    assert one["resultStatus"] == "Winner: Alpha One" and one["description"] == "Men Singles - １回戦 - Match 101"
    assert one["competitors"][0] == {"type": "player", "id": "1", "name": "Alpha One", "org": "Club A", "orgCode": None, "irm": None,
                                     "players": [{"id": None, "name": "Alpha One", "org": "Club A", "orgCode": None, "position": 1}]}
    assert one["gameScores"] == ["11-7", "9-11", "11-5", "11-8"]
    two = got["XD+XD202"]
    assert (two["competitors"][0]["name"], two["competitors"][0]["org"], two["competitors"][0]["type"]) == ("A B / D", "C1 / C2", "pair")
    assert two["competitors"][1]["org"] == "C3" and two["resultStatus"] is None and two["discipline"] == "mixed"
    assert len(got) == 2


def test_domestic_pages_fill_rounds(spark):
    def one(number, round_label):
        return fx.page("男子", round_label, f"MS+MS{number}", number, [("A", "C")], [("B", "D")])

    html = "".join(one(n, r) for n, r in [(101, ""), (102, "1回戦"), (103, ""), (104, "2回戦"), (105, ""), (106, "準決勝"), (107, "")])
    again = one(104, "2回戦").replace("3-1", "3-2")
    pages = spark.createDataFrame([("2024", 1, html), ("2024", 2, again)], "event string, page_id bigint, html string")
    rows = sorted(html_pages.domestic_pages_to_matches(pages).collect(), key=lambda r: r["matchNumber"])
    assert [r["roundLabel"] for r in rows] == ["1回戦", "1回戦", "1回戦", "2回戦", "", "準決勝", "準決勝"]
    assert rows[0]["roundKey"] == "knockout_round_1" and rows[0]["description"] == "Men Singles - 1回戦 - Match 101"
    assert rows[3]["overallScore"] == "3-2"


def test_link_tokens_and_coverage(spark):
    html = ('<a href="show.cgi?MS101">x</a><a href="show.cgi?WD201-WD204">y</a> MS準々決勝<br> ※ MS-301 WD-203 WD-210 '
            'href="timetable1A.shtml"')
    pages = spark.createDataFrame([("2024", 1, html)], "event string, page_id bigint, html string")
    tokens = html_pages.html_link_tokens(pages)
    ordered = [r["token"] for r in tokens.orderBy("position").collect()]
    assert ordered == ["MS101", "WD201-WD204", "MS301-MS304", "MS301", "WD203", "WD210"]
    planned = html_pages.uncovered_tokens(tokens).orderBy("rank", "position").collect()
    assert [r["token"] for r in planned] == ["WD201-WD204", "MS301-MS304", "MS101", "WD210"]
    assert [r["token"] for r in html_pages.timetable_paths(pages).collect()] == ["timetable1A.shtml"]


def item_frame(spark, rows):
    return frame(spark, [("9001", r) for r in rows], schema.ARCHIVE_ROW)


def test_recovered_items_are_preferred_on_a_tie(spark):
    primary = item_frame(spark, [fx.single_item("QF1--", "d", "0-0"), fx.single_item("QF2", "d"), {"match_card": {}}])
    recovered = item_frame(spark, [fx.single_item("QF1", "d", "3-2"), fx.single_item("QF2", "new"), fx.single_item("QF3", "d")])
    merged = merge_recovered(primary, recovered).orderBy("merged_seq").collect()
    assert [(r["documentCode"], r["match_card"]["overallScores"], r["match_card"]["subEventDescription"]) for r in merged] == [
        ("QF1", "3-2", "d"), ("QF2", "3-1", "new"), (None, None, None), ("QF3", "3-1", "d")]


def test_supplement_rules(spark):
    primary = item_frame(spark, [fx.team_item("A", "x", []), fx.team_item("B", "x", [fx.rubber("a", "b")]), fx.team_item("C", "x", [], score="0-0"),
                                 fx.single_item("D", "x")])
    extra = fx.matches(spark, [fx.match(i, event="9001", documentCode=c, overallScore="2-1", startDateLocal="s", matchType="team") for i, c in
                               enumerate(["A--", "B", "C", "D", "E", None])])
    merged = merge_supplemental(primary, extra).orderBy("merged_seq").collect()
    assert [(r["documentCode"], r["match_card"] is None) for r in merged] == [
        ("A", False), ("B", False), ("C", True), ("D", True), ("E", True), (None, True)]


def test_choose_feed(spark):
    primary = frame(spark, [("1", fx.single_item("QF1", "Men's Singles - Quarterfinals"))], schema.ARCHIVE_ROW)
    minimal = frame(spark, [("1", {"documentCode": "SF1"}), ("1", {"documentCode": "QF1"}), ("1", {"documentCode": "GP1"})], schema.ARCHIVE_ROW)
    recovered = frame(spark, [("1", fx.single_item("SF1--", "Men's Singles - Semifinals")), ("1", fx.single_item("GP1", "x"))], schema.ARCHIVE_ROW)
    standings = fx.matches(spark, [fx.match(0, event="1", documentCode="MTGP1", matchType="team"), fx.match(0, event="5", documentCode="ZZ")])
    daily = fx.matches(spark, [fx.match(0, event=e, documentCode="D" + e) for e in ("1", "2", "3", "4")])
    meta = spark.createDataFrame([("1", "wtt", "", None, None), ("2", "calendar", "", "2026-01-01", None), ("3", "bornan", "", "2026-01-01", None),
                                  ("4", "wtt", "", None, None)], "event string, source string, title string, startDate string, endDate string")
    rows = jobs.choose_feed(primary, minimal, recovered, standings, daily, meta).collect()
    assert sorted((r["event"], r["documentCode"]) for r in rows) == [("1", "MTGP1"), ("1", "QF1"), ("1", "SF1--"), ("3", "D3"), ("4", "D4")]
