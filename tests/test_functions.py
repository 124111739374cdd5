"""Expected values follow the rules of FIXTURES.md; all names are invented."""

from pyspark.sql import functions as F

from courtside.functions import dates, html, labels, names, scores, text


def test_text(column):
    assert column(text.norm_text, ["Men's  Singles!", None, "全日本", " U19-Boys "]) == ["mens singles", "", "", "u19 boys"]
    assert column(text.norm_search, ["Ána’s 全日本-2024"]) == ["ánas 全日本 2024"]
    assert column(text.norm_search_ascii, ["2026/03/08 007 a07", "000"]) == ["2026 3 8 7 a07", "0"]
    assert column(text.norm_code, ["X--", " X ", None]) == ["X", "X", ""]
    assert column(text.trim, ["　a  ﻿"]) == ["a"]
    assert column(text.norm_source, [None, "World Table Tennis", "All Japan", "全日本", "other"]) == [
        "wtt", "wtt", "zennihon", "zennihon", "other"]
    assert column(text.knockout_code, ["MSQF01--", "MSGP01", None]) == [True, False, False]


def test_gender_and_discipline(column):
    assert column(labels.infer_gender, ["Women's Singles", "Men's Teams", "U15 Girls Doubles", "U11 Boys' Singles", "Mixed Doubles",
                                        "Women's Mixed", "female", "Open", None, "U19 Boys Mixed"]) == [
        "women", "men", "women", "men", "mixed", "women", "women", None, None, "mixed"]
    assert column(labels.norm_discipline, ["Teams", "Mixed Team", "mixed doubles", "U19 Mixed Doubles", "Singles", "", "Relay"]) == [
        "teams", "teams", "mixed", "doubles", "singles", None, "relay"]


def test_rounds(column):
    cases = {"第２回戦": "knockout_round_2", "予選リーグ": "qualifying", "決勝トーナメント1回戦": "final", "準々決勝": "quarterfinal",
             "準決勝": "semifinal", "予選第１回戦": "qualifying_round_1", "１０回戦": "knockout_round_10", "ベスト16": "round_of_16",
             "Stage 1A - Group 3": "stage_1a_group", "Stage 1B": "stage_1b", "Quarter-Finals": "quarterfinal",
             "QF": "quarterfinal", "Gold Medal Match": "final", "Preliminary Round": "preliminary_round",
             "Qualifying Round 2": "qualifying_round_2", "Group 4": "group 4", "pool": "group", "": None,
             "Round of 32": "round_of_32", "グループ": "group", "Round 2": "round 2"}
    assert column(labels.norm_round, list(cases)) == list(cases.values())


def test_categories(column):
    def canonical(raw, desc, g, d):
        return labels.canonical_category(raw, desc, g, d)

    assert column(canonical, [
        ("Men's Singles", "", "men", "singles"), ("x", "U19 Boys' Singles - R16", None, None),
        ("U 15  girls Doubles", "", None, None), ("Women's Singles Class 1 - 5", "", "women", "singles"),
        ("Odd", "", "mixed", "teams"), ("Odd", "", None, None), ("Mixed Mixed", None, None, None)]) == [
        "Men Singles", "U19 Boys Singles", "U15 Girls Doubles", "Women Singles Class 1-5", "Mixed Teams", "Odd", "Mixed Doubles"]
    assert column(labels.para_category, [("Men's Singles Class 3", ""), ("Men's Singles", ""), (None, "Mixed Classes 1 – 2")]) == [
        "Men Singles Class 3", None, "Mixed Classes 1-2"]


def test_description_parts(column):
    assert column(labels.round_label, ["Men Singles - Round of 16 - Match 3", "A - Stage 1A - Group 2 - Match 1", "Men Semifinals Match 2", "plain"]) == [
        "Round of 16", "Stage 1A - Group 2", "Semifinals", None]
    assert column(labels.match_number, ["x - Match 12", "none", None]) == [12, None, None]
    assert column(labels.daily_round_label, ["MS.1.8FNL.01", "MS.1.GP07.1", "MS.1.509-.1", "MS.1.ZZ", "MS"]) == [
        "Round of 16", "Group 7", "Pos. 5-9", "", ""]


def test_names(column):
    assert column(names.name_candidates, ["Ann Lee", "Ann  May Lee", "Solo", ""]) == [
        ["Ann Lee", "Lee Ann", "LEE Ann", "Ann LEE"],
        ["Ann  May Lee", "Ann May Lee", "Lee Ann May", "LEE Ann May", "Ann May LEE"], ["Solo"], []]
    assert column(names.compact_name, ["山田 花子", "Ann Lee", "アン リー", "山田 花子 X"]) == ["山田花子", "Ann Lee", "アンリー", "山田 花子 X"]


def test_scores(column):
    assert column(scores.score_winner, ["W-L", "L-W", "3-3", "", "3-1", "1-3", "x-1", "3"]) == [0, 1, None, None, 0, 1, None, None]
    orgs = F.array(F.lit("AAA"), F.lit("BBB"))
    assert column(lambda c: scores.winner_org(c, orgs), ["3-1", "1-3", "2-2", "3", "-1", "W3-L0"]) == ["AAA", "BBB", None, None, "BBB", "AAA"]
    assert column(scores.split_games, ["11-7, 7-11,0-0,,11-9", None]) == [["11-7", "7-11", "11-9"], []]
    assert column(scores.is_zero_score, [" 0-0 ", "", None]) == [True, False, False]


def test_score_text(column):
    def shown(score, games, status, left):
        return scores.score_text(score, F.filter(F.split(games, ","), lambda g: g != ""), status, left.cast("int"), "ja")

    assert column(shown, [("1-1", "11-7,7-11", "", "0"), ("3-0", "11-7,11-8,11-9", "", "1"), ("0-0", "", "", "0"),
                          ("W-L", "", "", "0"), ("2-1", "11-5", "Retired", "0"), ("3-1", "11-x", "", "0"), ("1-0", "", "Winner: Awo", "0")]) == [
        "1(7,-7)1", "0(-7,-8,-9)3", "-", "不戦勝", "棄権", "3(11-x)1", "不戦勝"]


def test_zip_scores(spark):
    df = spark.sql("select array('11',' ','9') h, array('7','') a")
    assert df.select(scores.zip_scores(F.col("h"), F.col("a"))).first()[0] == ["11-7", "9-0"]


def test_dates(column):
    assert column(dates.date_range_label, [("2026-03-01", "2026-03-08"), ("2025-12-30", "2026-01-02"), ("2026-03-01", None), (None, "2026-03-08"), ("soon", None)]) == [
        "2026/3/1-8", "2025/12/30-1/2", "2026/3/1", "2026/3/8", "soon"]
    assert column(dates.date_tokens, [("03/05/2026 14:30:00", "2026-03-05T05:30:00Z"), (None, "2026-03-05"), ("later", "x")]) == [
        ["03/05/2026 14:30:00", "202603051430", "202603051430-", "2026-03-05", "2026-03-05 14:30", "2026/03/05",
         "2026/03/05 14:30", "2026-03-05T05:30:00Z", "202603050530", "202603050530-", "2026-03-05 05:30"],
        ["2026-03-05", "202603050000", "202603050000-", "2026-03-05 00:00"], ["later", "x"]]
    now = F.lit("2026-03-08").cast("date")
    assert column(lambda s, e, f, n: dates.lifecycle_status(s, e, f, n, now), [
        ("2026-03-01", "2026-03-08", "unknown", ""), ("2026-03-09", None, "unknown", ""), ("2026-01-01", "2026-03-07", "x", ""),
        (None, None, "unknown", "Open 2025"), (None, None, "unknown", "Open 2027"), (None, None, "live", "Open"),
        (None, None, "known", ""), ("soon", None, "fb", "Open 2025")]) == [
        "live", "upcoming", "finished", "finished", "upcoming", "unknown", "known", "fb"]
    assert column(lambda c: dates.ended_before(c, F.lit("2026-03-08")), ["2026-03-07", "2026-03-08", "yesterday"]) == [True, False, False]


def test_html(column):
    assert column(html.decode_entities, ["&#x65e5;&#26412;&amp;&nbsp;x &#38;#39;", "&#x1F3D3;"]) == ["日本& x &#39;", "🏓"]
    assert column(html.strip_html, ["<b>A</b>  &lt;B&gt; <br/> C"]) == ["A <B>\nC"]
    assert column(html.html_title, ["<title>T  1</title><h3>Head <i>x</i></h3>", "<title>T  1</title>", ""]) == ["Head x", "T 1", ""]


def test_event_names(column):
    assert column(labels.series, ["World Table Tennis Championships Finals 2026", "Youth Smash", "Champions X", "Star Contender", "Feeder", "Cup Finals", "Open", ""]) == [
        "World Championships", "Youth", "Champions", "Star Contender", "Feeder", "Finals", "Other", ""]
    assert column(labels.indexable_name, ["Open", "Test event", "contest", " ", None]) == [True, False, True, False, False]


def test_round_labels(column):
    def en(key, label):
        return labels.round_en(key, label)

    assert column(en, [("final", "x"), ("qualifying_round_2", ""), ("knockout_round_3", ""), ("z", "semi_finals"), ("k", None), (None, "Group 3")]) == [
        "Final", "Qualifying Round 2", "Round 3", "Semifinals", "k", "Group 3"]
    from courtside.sources.index import LabelRules

    def ja(key, label, number):
        return labels.round_ja(key, label, number.cast("int"), F.lit(None).cast("string"), LabelRules())

    assert column(ja, [("round_of_16", "Round of 16", "2"), ("qualifying_round_1", "", None), ("group 3", "Group 3", None),
                       ("stage_1a_group", "Stage 1A - Group 4", None), ("bronze_medal_match", "", None), ("other", "Other", None),
                       ("final", "Final", None)]) == [
        "決勝トーナメント2回戦", "予選トーナメント1回戦", "グループ3", "Stage1Aグループ4", "3位決定戦", "Other", "決勝トーナメント決勝"]
    assert column(lambda k, l, n: labels.round_sort_value(k, l, n.cast("int")), [
        ("knockout_round_3", "", None), ("group 2", "Group 2", None), ("x", "Stage 1B - Group 3", None), ("preliminary_round", "", None),
        ("round_of_16", "", "2"), ("final", "", None), ("x", "x", None)]) == [3, 2, 103, 99, 102, 105, 999]


def test_a_name_is_cut_once_for_all_its_spellings(spark):
    found = spark.createDataFrame([("Ann  Bea COE",), ("Ann COE",), ("  ",), (None,)], "n string").select(names.name_candidates(F.col("n")).alias("c"))
    assert found._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [r["c"] for r in found.collect()] == [
        ["Ann  Bea COE", "Ann Bea COE", "COE Ann Bea", "Ann Bea COE"][:3],
        ["Ann COE", "COE Ann", "Ann COE"][:2], [], []]
