import json

import pytest

from courtside.sources.archive import read_events, read_match_archive
from courtside.sources.index import read_dictionary, read_event_names, read_keyed_index, read_label_rules


@pytest.fixture
def archive(tmp_path):
    for event, codes in (("ev1", ["A", "B"]), ("ev2", ["C"]), ("cup 2024", ["D"])):
        (tmp_path / f"{event}.json").write_text(json.dumps([{"documentCode": c, "matchType": "individual", "categoryName": "Men Singles", "competitors": []} for c in codes]))
    return tmp_path


def codes(df):
    return sorted((r["event"], r["documentCode"]) for r in df.collect())


def test_archive_by_folder_pattern_scheme_and_file(spark, archive):
    everything = [("cup 2024", "D"), ("ev1", "A"), ("ev1", "B"), ("ev2", "C")]
    assert codes(read_match_archive(spark, str(archive))) == everything
    assert codes(read_match_archive(spark, f"file:{archive}")) == everything
    assert codes(read_match_archive(spark, f"{archive}/*.json")) == everything
    assert codes(read_match_archive(spark, f"{archive}/ev*.json")) == everything[1:]
    assert codes(read_match_archive(spark, f"{archive}/ev[2].json")) == everything[3:]
    assert codes(read_match_archive(spark, f"file://{archive}/ev2.json")) == everything[3:]


def test_only_absent_paths_are_empty(spark, archive):
    for path in (f"{archive}/none", f"file:{archive}/none.json", f"{archive}/x*.json"):
        assert read_match_archive(spark, path).count() == 0
        assert read_dictionary(spark, path).count() == 0
        assert read_event_names(spark, path).count() == 0
        assert read_keyed_index(spark, path, "a string").columns == ["event", "a", "present"]
        assert read_label_rules(spark, path).knockout_prefix
    (archive / "ev3.json").write_text("[{broken")
    with pytest.raises(Exception):
        read_match_archive(spark, str(archive)).collect()


def test_events_are_named_alike_by_all_readers(spark, archive):
    rows = read_events(spark, str(archive), "documentCode string")
    assert {r["event"] for r in rows.collect()} == {"cup 2024", "ev1", "ev2"}


def test_index_fields_of_any_type(spark, tmp_path):
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"1": {"event": "x", "m": {"k": "v", "w": None}, "d": 1.25, "s": {"a": 1, "b": [2, 3]}},
                                "2": {"d": None}}))
    ddl = "event string, m map<string,string>, d decimal(10,2), s struct<a:int,b:array<int>>"
    got = {r["event"]: r for r in read_keyed_index(spark, f"file:{path}", ddl).collect()}
    assert got["1"]["m"] == {"k": "v", "w": None} and str(got["1"]["d"]) == "1.25" and got["1"]["s"]["b"] == [2, 3]
    assert got["2"]["d"] is None and got["2"]["present"] == ["d"]


def test_pages_in_their_charset(spark, tmp_path):
    from courtside.operators.html_pages import html_tables_to_matches
    from courtside.sources.pages import read_pages
    from tests.fixtures import page

    html = page("男子", "1回戦", "MS+MS1001", 7, [("山田<br>太郎", "クラブ(東京)")], [("鈴木", "会社")], winner="山田 太郎")
    (tmp_path / "ev 1").mkdir()
    (tmp_path / "ev 1" / "12.shtml").write_bytes(html.encode("euc-jp"))
    (tmp_path / "ev 1" / "notes.txt").write_bytes(b"x")
    (row,) = read_pages(spark, str(tmp_path), "euc-jp").collect()
    assert (row["event"], row["page_id"], row["html"]) == ("ev 1", 12, html)
    (match,) = html_tables_to_matches(read_pages(spark, f"{tmp_path}/ev*", "euc-jp")).collect()
    assert match["matchNumber"] == 7 and match["seq"] == 1 and match["competitors"][0]["players"][0]["org"] == "クラブ"
    assert "�" in read_pages(spark, str(tmp_path), "ascii").first()["html"]
    assert read_pages(spark, f"{tmp_path}/none").count() == 0
