import json
import random

import pytest
from pyspark.sql import functions as F

from courtside.sources.archive import read_items
from courtside.sources.index import read_dictionary, read_event_names, read_keyed_index
from courtside.sources.json_ranges import CorruptJson, json_records


def text(r, most=30):
    return "".join(r.choice('ab{}[],:"\\é日\n ') for _ in range(r.randrange(most)))


def record(r):
    return {"documentCode": text(r), "matchType": r.choice([None, "individual", text(r)]), "gameScores": [text(r, 9) for _ in range(r.randrange(4))],
            "deep": [{"x,": [{"}": text(r)}, [], {}, 1.5, True, None]}]}


@pytest.fixture(params=[400, 1 << 20])
def ranges(spark, request):
    """Byte ranges so short that strings, escapes and records lie across them, and ranges of a whole file."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [0, 1])
def test_any_array_of_objects(spark, tmp_path, ranges, seed):
    r = random.Random(seed)
    items = {f"{n} ä[1]": [record(r) for _ in range(60)] for n in "ab"}
    for name, rows in items.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, ensure_ascii=seed == 0, indent=seed or None) + "\n" * seed)
    paths = [str(tmp_path / f"{n} ä\\[1\\].json") for n in "ab"]
    for mark in "},":
        records = json_records(spark, paths, 1, mark).orderBy("file", "seq")
        if ranges < 1000:
            assert records.select("file", F.shiftright("seq", 33)).distinct().count() > 10
        assert [json.loads(x["text"]) for x in records.collect()] == items["a ä[1]"] + items["b ä[1]"]


def test_equals_the_reader_of_small_files(spark, tmp_path, ranges):
    r = random.Random(3)
    for name, count in (("ev 1", 80), ("ev2", 1), ("none", 0)):
        (tmp_path / f"{name}.json").write_text(json.dumps([record(r) for _ in range(count)], indent=2))

    def rows(split):
        found = read_items(spark, str(tmp_path), split).orderBy("event", "seq").collect()
        assert len({(x["event"], x["seq"]) for x in found}) == len(found)
        return [(x["event"], *[v for k, v in x.asDict().items() if k not in ("event", "seq")]) for x in found]

    assert rows(0) == rows(1 << 30) == rows(2000)


def test_keyed_objects(spark, tmp_path, ranges):
    r = random.Random(4)
    index = {f"{i}{text(r, 6)}": {"a": text(r), "s": {"b": [1, text(r)]}, **({"n": None} if i % 3 else {})} for i in range(70)}
    names = {**{f"{i}{text(r, 6)}": "n" + text(r) for i in range(50)}, "src": {f"{i}": text(r) for i in range(40)}, "x,{": {"1": "}"}, "none": {}}
    words = {"teams": {f"{i}{text(r, 5)}": text(r) for i in range(40)}, "version": 3, "other": {"a": "b", "c": {"d": "e"}},
             "players": {f"{i}": text(r) for i in range(60)}, "headers": {}, "rounds": None}
    paths = {}
    for name, value in (("index", index), ("names", names), ("words", words)):
        paths[name] = str(tmp_path / f"{name}.json")
        with open(paths[name], "w") as f:
            json.dump(value, f, ensure_ascii=False)

    def both(read):
        a, b = (sorted(map(str, read(split).collect())) for split in (0, 1 << 30))
        assert a == b and a

    both(lambda split: read_keyed_index(spark, paths["index"], "a string, s struct<b:array<string>>", split_bytes=split))
    both(lambda split: read_event_names(spark, paths["names"], split))
    both(lambda split: read_dictionary(spark, paths["words"], True, split))


@pytest.mark.parametrize("content", ["[{broken", '[{"a":1}', '[{"a":"x}]', '{"a":{}}}', '[{"a":1}]]', '[{"a":{"b":1}', '{"a":{"b":1}, "c" {"d":2}}'])
def test_corrupt_files(spark, tmp_path, content):
    path = tmp_path / "bad.json"
    path.write_text(content)
    with pytest.raises(Exception):
        read_items(spark, str(path), 0).collect()
    assert read_keyed_index(spark, str(path), "b int", split_bytes=0).collect() == []
    with pytest.raises(Exception):
        read_keyed_index(spark, str(path), "b int", corrupt="raise", split_bytes=0).collect()


def test_blank_files_have_no_records(spark, tmp_path):
    for i, content in enumerate(["", " \n", "[]", "{ }", "[\n]\n"]):
        path = tmp_path / f"{i}.json"
        path.write_text(content)
        assert json_records(spark, [str(path)]).collect() == []
    with pytest.raises(CorruptJson):
        (tmp_path / "open.json").write_text('["')
        json_records(spark, [str(tmp_path / "open.json")])


def test_a_record_over_many_ranges(spark, tmp_path, ranges):
    rows = [{"documentCode": "a"}, {"documentCode": "{}," * 20000}, {"documentCode": "c"}]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    found = read_items(spark, str(tmp_path), 0).orderBy("seq").collect() if ranges > 400 else None
    assert found is None or [x["documentCode"] for x in found] == [x["documentCode"] for x in rows]
