"""Large JSON files read by many tasks: each takes a byte range, wherever it begins.

A text reader with a JSON mark as line separator hands out ranges that begin behind such a mark. What a byte means depends on
all bytes before it, but only through two facts: whether they end inside a string, and how deep. So a first pass sums up each range
for both beginnings (quotes, change of depth), a running sum over the ranges of a file tells how each really begins, and a
second pass cuts the records. What a range holds of a record that others share leaves as a fragment, at most two from each range;
fragments are put together by their order. A task holds a chunk and one record at a time, the driver one row for each range of
a file that has several.

A mark inside a string is text like any other. Contract: UTF-8; blank texts between marks are no records; a file that ends
inside a string or at another depth than it began is corrupt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20         # bytes that a task looks at once
SPLIT_BYTES = 64 << 20  # files up to this size are read by one task
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_TURN = np.zeros(256, np.int8)
_TURN[[ord("{"), ord("[")]], _TURN[[ord("}"), ord("]")]] = 1, -1
_MARK = _TURN != 0
_MARK[ord(",")] = True


class CorruptJson(ValueError):
    """A file whose marks do not match."""


def _outside(raw: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are outside strings, and whether the last one leaves a string open. No range begins behind a backslash."""
    quotes = np.flatnonzero(raw == _QUOTE)
    if len(quotes):
        other = np.where(raw != _BACKSLASH, np.arange(len(raw)), -1)
        before = np.append(-1, np.maximum.accumulate(other))[quotes]  # the last byte before each quote that is no backslash
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    turns = np.zeros(len(raw), np.int8)
    turns[quotes] = 1
    outside = (np.cumsum(turns, dtype=np.int64) + inside) % 2 == 0
    return outside, bool((len(quotes) + inside) % 2)


def _chunks(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[tuple, bytes, bool]]:
    """(range, bytes, whether the range ends here): the pieces of each range with the mark that ended them."""
    key, held, size = None, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length", "piece"))):
            if key != row[:3] or size >= CHUNK:
                if key is not None:
                    yield key, b"".join(held), key != row[:3]
                key, held, size = row[:3], [], 0
            held += [row[3], mark]
            size += len(row[3]) + 1
    if key is not None:
        yield key, b"".join(held), True


def _summed(mark: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, outer, inner, size = 0, 0, 0, 0
        for (file, start, length), text, ends in _chunks(batches, mark):
            raw = np.frombuffer(text, np.uint8)
            outside, odd = _outside(raw, bool(quotes % 2))
            turn = _TURN[raw]
            outer, inner = outer + int(turn[outside].sum(dtype=np.int64)), inner + int(turn[~outside].sum(dtype=np.int64))
            quotes, size = quotes + (odd != bool(quotes % 2)), size + len(text)
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, start, length, quotes % 2, outer, inner, size)],
                                                 names=["file", "start", "length", "quotes", "outer", "inner", "size"])
                quotes, outer, inner, size = 0, 0, 0, 0
    return run


_SUMMED = "file string, start long, length long, quotes long, outer long, inner long, size long"
_PARTS = "file string, number long, ordinal long, depth int, kind int, text binary"
_WHOLE, _OPENS, _GOES_ON = 0, 1, 2


def _cut(mark: bytes, limit: int, begins: dict[tuple[str, int], tuple[int, bool, int, bool]]):
    """Records and fragments. ``begins``: number, inside, depth and unmarked end of each range that is not a whole, sound file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for (file, start, _), text, ends in _chunks(batches, mark):
            if at != (file, start):
                number, inside, depth, unmarked = begins.get((file, start), (1, False, 0, False))
                at, level, ordinal, held = (file, start), depth, 0, []
                kind = _OPENS if number == 1 else _GOES_ON
            if ends and unmarked:
                text = text[:-len(mark)]
            raw = np.frombuffer(text, np.uint8)
            outside, inside = _outside(raw, inside)
            places = np.flatnonzero(outside & _MARK[raw])
            turn = _TURN[raw[places]].astype(np.int64)
            after = depth + np.cumsum(turn)
            cuts = np.flatnonzero(after - np.minimum(turn, 0) <= limit)  # the depth inside the mark's own bracket
            rows, last = [], 0
            for place, deep in zip(places[cuts].tolist(), after[cuts].tolist()):
                record = b"".join([*held, text[last:place]])
                if kind != _WHOLE or record.strip():
                    rows.append((ordinal if kind != _GOES_ON else -1, level, kind, record))
                    ordinal += 1
                held, last, level, kind = [], place + 1, deep, _WHOLE
            held.append(text[last:])
            depth = int(after[-1]) if len(after) else depth
            if ends:
                rows.append((ordinal if kind != _GOES_ON else -1, level, _OPENS if kind == _WHOLE else kind, b"".join(held)))
            if rows:
                ordinals, levels, kinds, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows)), pa.array([number] * len(rows), pa.int64()), pa.array(ordinals, pa.int64()),
                     pa.array(levels, pa.int32()), pa.array(kinds, pa.int32()), pa.array(texts, pa.binary())],
                    names=["file", "number", "ordinal", "depth", "kind", "text"])
    return run


def json_records(spark: SparkSession, paths: list[str], depth: int = 1, mark: str = "}", corrupt: str = "raise") -> DataFrame:
    """(file, seq, depth, text): what lies between the marks of depth ``depth`` and less, in file order by ``seq``.

    With depth 1 these are the elements of an array or the ``"key":value`` entries of an object; with depth 2 also the entries one
    level further down, the outer texts then being their heads. ``mark`` should be frequent: ``}`` where records are objects, ``,``
    where they are plain values. A corrupt file is an error or, with ``corrupt="empty"``, has no rows.
    """
    lines = spark.read.option("lineSep", mark).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("piece"))
    in_order = Window.partitionBy("file").orderBy("start")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (lines.mapInArrow(_summed(mark.encode()), _SUMMED)
              .withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
              .withColumn("change", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
              .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
              .withColumn("number", F.row_number().over(in_order))
              .withColumn("last", F.lead("start").over(in_order).isNull())
              # the reader does not tell whether the last piece had its mark; the lengths do
              .withColumn("unmarked", F.col("last") & (F.sum("size").over(Window.partitionBy("file")) > F.col("length"))))
    closing = {"}": -1}.get(mark, 0)
    ending = F.col("depth") + F.col("change") - F.when(F.col("unmarked") & (F.col("inside") == (F.col("quotes") == 1)), closing).otherwise(0)
    bad = F.col("last") & ((ending != 0) | (F.col("inside") != (F.col("quotes") == 1)))
    told = ranges.withColumn("bad", bad).filter("start > 0 or not last or unmarked or bad").collect()
    broken = sorted({r["file"] for r in told if r["bad"]})
    if broken and corrupt == "raise":
        raise CorruptJson(f"brackets or quotes do not match in {', '.join(broken[:5])}")
    begins = {(r["file"], r["start"]): (r["number"], r["inside"], r["depth"], r["unmarked"]) for r in told}

    parts = lines.filter(~F.col("file").isin(broken)) if broken else lines
    parts = parts.mapInArrow(_cut(mark.encode(), depth, begins), _PARTS)
    position = (F.shiftleft("number", 33) + F.col("ordinal")).alias("seq")
    whole = parts.filter(F.col("kind") == _WHOLE).select("file", position, "depth", "text")
    shared = parts.filter(F.col("kind") != _WHOLE).withColumn("record", F.sum(F.when(F.col("kind") == _OPENS, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("number", "ordinal")))
    joined = shared.groupBy("file", "record").agg(
        F.min(F.struct("number", "ordinal", "depth")).alias("first"),
        F.sort_array(F.collect_list(F.struct("number", "ordinal", "text"))).alias("texts"))
    joined = joined.select("file", (F.shiftleft("first.number", 33) + F.col("first.ordinal")).alias("seq"), "first.depth",
                           F.concat_ws("", F.transform("texts", lambda t: t["text"].cast("string"))).cast("binary").alias("text"))
    rows = whole.unionByName(joined)
    return rows.select("file", "seq", "depth", F.col("text").cast("string").alias("text")).filter(F.regexp_like("text", F.lit(r"[^ \t\r\n]")))


def json_sections(spark: SparkSession, paths: list[str], mark: str = ",", corrupt: str = "raise") -> tuple[DataFrame, DataFrame]:
    """An object of plain values and of objects of entries: (file, text) of the ``"key":value`` entries of the outer one, and
    (file, section, text) of those of each object in it. The keys of the inner objects, few by format, pass through the driver."""
    records = json_records(spark, paths, 2, mark, corrupt)
    heads = records.filter((F.col("depth") == 1) & F.rtrim("text").endswith(":"))
    found = sorted((r["file"], r["seq"], json.loads(r["text"].strip()[:-1])) for r in heads.collect())
    ends = [after[1] if after[0] == head[0] else 1 << 62 for head, after in zip(found, [*found[1:], ("", 0, "")])]
    sections = spark.createDataFrame([(*head, end) for head, end in zip(found, ends)], "file string, begin long, section string, end long")
    inner = records.filter("depth = 2").join(sections, "file").filter("seq > begin and seq < end")
    return (records.filter((F.col("depth") < 2) & ~F.rtrim("text").endswith(":")).select("file", "text"), inner.select("file", "section", "text"))


def entry_of(text) -> Column:
    """The one-entry map of a ``"key":value`` text; null if it is none."""
    return F.from_json(F.concat(F.lit("{"), text, F.lit("}")), "map<string,string>")


def file_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under ``path``, none of them read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def large_files(spark: SparkSession, path: str, split_bytes: int) -> list[str]:
    """Files that are worth several tasks, as plain paths: no character of a name is a pattern."""
    found = file_lengths(spark, path).filter(F.col("length") > split_bytes).collect()
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in found]
