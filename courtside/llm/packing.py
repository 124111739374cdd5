"""Operator 10: sequences packed along a space-filling curve, so that similar documents share a sequence.

A document's token ids are hashed into a unit vector, projected to three dimensions and placed on a Hilbert curve; all
documents are sorted by their key in ranges and laid end to end, and the line is cut every ``length`` tokens. Only the
very last sequence has padding, so there is nothing to fill.

Contract. A null text is an empty one and gives its end id. Equal texts have one key; such a group, however large, is
spread over ranges by a hash of ``doc_id`` in the low bits. Repeated rows are kept. An empty table gives no pieces.
Other columns of the input are never touched. A document longer than ``length`` gives several pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, slices, staged, width
from courtside.llm.tokens import ID, encoder

LENGTH = 4096
FEATURES, DIMS, BITS = 256, 3, 13
_TOKENS = "doc_id long, n long, curve long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below ``2 ** bits``; one row per point.

    From the highest bit down, each level reflects or swaps the lower bits by what the level above chose; a Gray code of
    the outcome is the place.
    """
    x = axes.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for d in range(dims):
            high = (x[d] & bit) > 0
            differ = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, differ)
            x[d] ^= differ
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((x[-1] & bit) > 0, bit - one, np.uint64(0))
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << one) | ((x[d] >> np.uint64(level)) & one)
    return place


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids stand in a row."""
    slot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(owner * FEATURES + slot.astype(np.int64), minlength=len(lengths) * FEATURES)
    vectors = np.sqrt(counts.reshape(-1, FEATURES))
    vectors /= np.maximum(np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)), 1e-12)
    directions = np.random.default_rng(10).standard_normal((FEATURES, DIMS))
    directions -= directions.mean(axis=0)  # what all documents share decides nothing
    spread = 1 / (1 + np.exp(-4 * (vectors @ directions)))
    return hilbert_index(np.minimum(spread * (1 << BITS), (1 << BITS) - 1), BITS).astype(np.int64)


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], ID).tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            ids = [i + end for i in encoder(vocabulary).encode(batch.column("text").to_pylist())]
            lengths = np.array([len(i) // ID.itemsize for i in ids])
            keys = np.concatenate([curve_keys(np.frombuffer(b"".join(ids[a:a + 512]), ID), lengths[a:a + 512])
                                   for a in range(0, len(ids), 512)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(keys, pa.int64()),
                pa.array([_narrow(i) for i in ids], pa.binary()),
            ], names=["doc_id", "n", "curve", "ids"])
    return run


def _narrow(ids: bytes) -> bytes:
    """A tag and the ids in two bytes each, where they all fit."""
    values = np.frombuffer(ids, ID)
    return b"2" + values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else b"4" + ids


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else ID, offset=1).astype(ID)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, line = None, 0
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            rows = {name: [] for name in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            columns = [batch.column(c).to_pylist() for c in ("part", "part_start", "doc_id", "n", "ids")]
            for now, part_start, doc, n, ids in zip(*columns):
                if now != part:
                    part, line = now, part_start
                values, start = _wide(ids), 0
                while start < n:
                    sequence, offset = divmod(line + start, length)
                    size = min(n - start, length - offset)
                    piece = values[start:start + size].tobytes()
                    for name, value in zip(rows, (doc, start, size, piece, n, sequence, offset)):
                        rows[name].append(value)
                    start += size
                line += n
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))
    return run


def _part_of(cuts: list[int]):
    @F.pandas_udf("int")
    def part(key):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, np.int64), key.to_numpy(), side="left").astype(np.int32))
    return part


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian unsigned 32-bit).

    Texts are tokenised once, into a table in the shared folder. The ranges of the sort are cut at quantiles of the keys;
    the tokens of each range give the place at which it begins, so that all ranges lay out their documents at once.
    """
    spark = docs.sparkSession
    parts = parts or width(spark)
    tokens = need(docs, "doc_id", "text").mapInArrow(_tokenise(vocabulary, end_id), _TOKENS)
    # 39 bits of the curve, then 24 of a hash that orders equal keys and tells ranges of them apart.
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32("ids")), 40)
    tokens = staged(tokens.withColumn("key", F.shiftleft("curve", 24).bitwiseOR(tie)), "tokens", shared_folder(spark))
    shares = [i / parts for i in range(1, parts)]
    cuts = tokens.select(F.percentile_approx("key", shares, 20 * parts).alias("cuts")).first()["cuts"] if shares else []
    keyed = tokens.withColumn("part", _part_of(sorted(set(cuts or [])))("key"))
    # One row per range: small however many documents there are.
    sizes = keyed.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    dealt = (keyed.repartitionById(parts, "part").join(F.broadcast(starts), "part")
             .sortWithinPartitions("part", "key", "doc_id"))
    return dealt.select("part", "part_start", "doc_id", "n", "ids").mapInArrow(_cut(length), _PIECES)


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
