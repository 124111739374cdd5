import os
import random

import pytest
from pyspark.sql import functions as F

from courtside.operators.trigrams import TrigramIndex, trigrams

def indexed(index, df):
    return index.write(df, F.col("k"), F.col("t"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, block string, gram int").repartition(5)


def make(rows):
    return [(k, t, "x", 1) for k, t in rows]


def found(index, spark, *needles):
    return sorted(((r["key"], r["text"]) for r in index.find(spark, needles).collect()), key=repr)


def brute(rows, *needles):
    return sorted(((k, t or "") for k, t in rows if all(n in (t or "") for n in needles)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    some = [(f"k{i}", "".join(rng.choices("ab é語😀", k=rng.choice([0, 1, 2, 3, 9, 40])))) for i in range(300)]
    hot = [("hot", f"a b{i % 50} abab") for i in range(200)]  # one key with a third of all rows
    return [*some, *hot, (None, "ab null key a😀b"), ("none", None), ("k7", "ab again"), ("k7", "ab again"), ("long", "ab " * 30000 + "needle")]


def test_finds_what_a_scan_finds(spark, rows, tmp_path):
    index = indexed(TrigramIndex(str(tmp_path / "i"), 8), frame(spark, make(rows)))
    for needles in (["ab "], ["aba", "b b"], ["😀語a"], ["a😀b"], ["needle"], ["zzz"], ["ab again"], ["null key"], ["b4", "aba"], ["ab"], [""], []):
        assert found(index, spark, *needles) == brute(rows, *needles), needles
    some = index.find(spark, ["aba"], F.col("key") == "hot")
    assert some.count() == 200


def test_an_upsert_rewrites_its_blocks_only(spark, rows, tmp_path):
    index = indexed(TrigramIndex(str(tmp_path / "i"), 16), frame(spark, make(rows)))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "i") for f in names if f.endswith(".parquet")}

    before = files()
    new = [("k7", "quite new"), ("new", "quite new too"), (None, "quite null"), ("hot", "ab once")]
    for _ in range(2):  # running it again changes nothing
        index.upsert(frame(spark, make(new)), F.col("k"), F.col("t"))
        now = [*[r for r in rows if r[0] not in {"k7", None, "hot"}], *new]
        for needles in (["quite"], ["quite", "new"], ["ab "], ["abab"], ["null key"], [""]):
            assert found(index, spark, *needles) == brute(now, *needles), needles
    blocks = {os.path.basename(os.path.dirname(f)) for f in before - files()}
    assert len(blocks) <= 4 and len(before & files()) >= len(before) // 2


def test_only_the_needles_postings_are_read(spark, rows, tmp_path):
    index = indexed(TrigramIndex(str(tmp_path / "i"), 8), frame(spark, make(rows)))
    plan = index.find(spark, ["aba"])._jdf.queryExecution().toString()
    assert "In(gram, [aba])" in plan or "EqualTo(gram,aba)" in plan
    assert "dynamicpruning" in plan
    assert trigrams(["abcd", "bcd", "x"]) == ["abc", "bcd"]


def test_empty_table(spark, tmp_path):
    index = indexed(TrigramIndex(str(tmp_path / "i"), 8), frame(spark, []))
    assert found(index, spark, "abc") == [] and found(index, spark) == []
    index.upsert(frame(spark, make([("a", "abcd")])), F.col("k"), F.col("t"))
    assert found(index, spark, "bcd") == [("a", "abcd")]
