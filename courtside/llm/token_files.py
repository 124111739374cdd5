"""Operator 8: token ids of whole texts in Simple-8b files, written in document order and read back.

Contract. Documents are ordered by ``doc_id`` (null first, equal ids by text); a null text is an empty one. Every
document ends with ``end_id``. Repeated rows are kept, each with its own place. An empty table gives a folder without
blocks, which reads as no rows. Columns of the input other than ``doc_id`` and ``text`` are never touched.

A file table has one row per block: ``part`` and ``block`` (its place), ``before`` (ids of the part before it),
``doc_ids``, ``offsets`` (places in the block at which its documents end) and ``words`` (``simple8b``). A block
holds whole documents, so any block is decoded alone and all its documents at once. Parts are ranges of
``doc_id``; a part's length is the sum over its blocks, so readers need one number per part to know all places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtside.llm.common import need, slices, width
from courtside.llm.simple8b import decode_blocks, encode_blocks
from courtside.llm.tokens import ID, encoder

BLOCK_IDS = 8192
_FILE = "part int, block int, before long, n_ids long, doc_ids array<long>, offsets array<int>, words binary"
_READ = "part int, doc_id long, place long, n_tokens long, ids binary"


def _encode(vocabulary: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], ID).tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            docs = batch.column("doc_id").to_pylist()
            ids = [i + end for i in encoder(vocabulary).encode(batch.column("text").to_pylist())]
            lengths = np.array([len(i) // ID.itemsize for i in ids])
            ends = np.cumsum(lengths)
            # A block closes with the first document that fills it.
            closing = np.flatnonzero(np.diff((ends - 1) // block_ids, append=-1))
            firsts = np.concatenate([[0], closing[:-1] + 1])
            values = np.frombuffer(b"".join(ids), ID).astype(np.uint64)
            words = encode_blocks(values, ends[closing])
            starts = ends[firsts] - lengths[firsts]
            n_ids = ends[closing] - starts
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(words), pa.int32()),
                pa.array(range(block, block + len(words)), pa.int32()),
                pa.array(before + starts, pa.int64()),
                pa.array(n_ids, pa.int64()),
                pa.array([docs[a:b + 1] for a, b in zip(firsts, closing)], pa.list_(pa.int64())),
                pa.array([ends[a:b + 1] - s for a, b, s in zip(firsts, closing, starts)], pa.list_(pa.int32())),
                pa.array(words, pa.binary()),
            ], names=["part", "block", "before", "n_ids", "doc_ids", "offsets", "words"])
            block, before = block + len(words), before + int(ends[-1])
    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = BLOCK_IDS,
                      parts: int | None = None) -> None:
    """Writes the ids of all documents to ``path``. The one shuffle deals out ranges of ``doc_id``, so that each task
    writes consecutive documents; equal ids are told apart by their text, so no id fills a task."""
    spark = docs.sparkSession
    rows = need(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = (rows.repartitionByRange(parts or width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .select("doc_id", "text"))
    rows.mapInArrow(_encode(vocabulary, end_id, block_ids), _FILE).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            rows = batch.slice(at, 32)
            values, lengths = decode_blocks(rows.column("words").to_pylist())
            ids = values.astype(ID)
            counts = np.array([len(o) for o in rows.column("offsets").to_pylist()])
            first = np.cumsum(lengths) - lengths
            inner = rows.column("offsets").flatten().to_numpy()
            stop = inner + np.repeat(first, counts)
            start = np.concatenate([[0], stop[:-1]])
            place = start - np.repeat(first, counts) + np.repeat(rows.column("before").to_numpy(), counts)
            data = pa.py_buffer(ids)
            edges = pa.py_buffer(np.append(start, stop[-1:]).astype(np.int64) * ID.itemsize)
            whole = pa.Array.from_buffers(pa.large_binary(), len(stop), [None, edges, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(rows.column("part").to_numpy(), counts), pa.int32()),
                rows.column("doc_ids").flatten(), pa.array(place, pa.int64()),
                pa.array(stop - start, pa.int64()), whole,
            ], names=["part", "doc_id", "place", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``ids`` as little-endian unsigned 32-bit."""
    files = spark.read.schema(_FILE).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part, however many documents there are: small enough for every task.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    return (files.select("part", "before", "doc_ids", "offsets", "words").mapInArrow(_decode, _READ)
            .join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("part_start") + F.col("place")).alias("start"), "n_tokens", "ids"))


def query(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    write_token_files(docs, path, vocabulary)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
