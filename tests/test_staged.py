"""Costly tables are made once, however often a plan reads them; tasks of spread tables grow in number, not in size."""

import pytest
from pyspark.sql import functions as F

from checks import QUERIES, tables
from courtside import schema
from courtside.operators import html_pages, normalize
from courtside.operators.filters import MatchArgs
from courtside.plans import jobs
from tests import fixtures as fx
from tests.test_feeds import daily_side, frame


def counted(spark, df, column):
    """``df`` and a counter of how often ``column`` was computed."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(value):
        made.add(1)
        return value

    return df.withColumn(column, same(column)), made


def test_pages_are_parsed_once(spark):
    html = [fx.page("男子", "1回戦", f"MS+MS{n}", n, [("A", "C")], [("B", "D")]) for n in (101, 102, 103)]
    pages = spark.createDataFrame([("2024", i, h) for i, h in enumerate(html)], "event string, page_id bigint, html string")
    pages, made = counted(spark, pages, "html")
    assert len(html_pages.domestic_pages_to_matches(pages).collect()) == 3
    assert made.value == 3


def test_daily_items_are_normalised_once(spark):
    items = frame(spark, [("7", {"Key": f"MS.1.QFNL.{i}", "Home": daily_side("X", "AAA", "1"), "Away": daily_side("Y", "BBB", "0")}) for i in range(3)],
                  schema.DAILY_ITEM)
    items, made = counted(spark, items, "Desc")
    names = spark.createDataFrame([], "event string, event_key string, description string, position int")
    assert len(normalize.daily_feed_to_matches(items, names).collect()) == 3
    assert made.value == 3


def test_feeds_are_merged_once_before_numbering(spark):
    primary = frame(spark, [("1", fx.single_item("QF1", "Men's Singles - Quarterfinals"))], schema.ARCHIVE_ROW)
    none = primary.filter("false")
    ties, made = counted(spark, fx.matches(spark, [fx.match(i, event="1", documentCode=f"MT{i}", matchType="team") for i in range(2)]), "documentCode")
    meta = spark.createDataFrame([], "event string, source string, title string, startDate string, endDate string")
    rows = jobs.choose_feed(primary, none, none, ties, ties.filter("false"), meta).collect()
    assert sorted((r["seq"], r["documentCode"]) for r in rows) == [(1, "QF1"), (2, "MT0"), (3, "MT1")]
    assert made.value == 2


def test_spread_tables_make_more_tasks_of_more_rows(spark, tmp_path, monkeypatch):
    spark.range(100).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(tables, "TASK_ROWS", 5, raising=False)
    assert tables.spread_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 20


@pytest.mark.parametrize("name", ["q_normalise_labels", "q_pending_doubles"])
def test_costly_rows_are_dealt_to_all_cores(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("mode", ["ja", "en"])
def test_report_rows_are_made_once(spark, mode):
    ties = fx.matches(spark, [fx.match(i, event="1", categoryName=f"C{i}", overallScore="3-1") for i in range(2)])
    ties, made = counted(spark, ties, "categoryName")
    rows = jobs.match_query(ties, MatchArgs(mode=mode)).collect()
    assert {r["row_no"] for r in rows} == {1, 2}
    assert made.value == 2
