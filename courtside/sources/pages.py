"""Stored result pages: bytes in any charset to the text that the page operators read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.paths import present


def decoded(content: Column, charset: str) -> Column:
    """Text of ``content``; what the charset does not know becomes the replacement character. Spark itself decodes only
    Unicode and Latin, so other charsets are decoded batch by batch."""
    @F.pandas_udf("string")
    def decode(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else page.decode(charset, errors="replace"))

    return decode(content)


def decode_pages(pages: DataFrame, charset: str, content: str = "content") -> DataFrame:
    """Pages (event, page_id, content) as (event, page_id, html)."""
    return pages.select("event", "page_id", decoded(F.col(content), charset).alias("html"))


def read_pages(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """Files ``<event>/<number>.<any ending>`` under ``path`` as (event, page_id, html). A path that names nothing has
    no rows; a file whose name is no number is no page."""
    if not present(spark, path):
        return spark.createDataFrame([], "event string, page_id bigint, html string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("_metadata.file_name")
    event = F.url_decode(F.element_at(F.split("path", "/"), -2))
    pages = files.select(event.alias("event"), F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1).try_cast("bigint").alias("page_id"),
                         "content")
    return decode_pages(pages.filter("page_id is not null"), charset)
