"""Operator 5: a uniform shuffle of all rows into shards of exact size, by a hypergeometric communication matrix.

The rows of every input partition are dealt to cells, the cells of a shard being equal runs of its slots. How many rows
partition ``p`` sends to cell ``c`` is drawn exactly: the counts of a uniform shuffle are multivariate hypergeometric.
The matrix is never built. Partitions are the leaves of a binary tree whose every node splits the room left in
each cell between its halves with random numbers keyed by the node, so each task draws its own row of the matrix along
one path, and all tasks agree. Each task permutes its rows, sends them, and each cell permutes what it got.

Law ``rows``: shard sizes differ by one at most.

Contract. Every row, also one with a null or repeated ``doc_id``, gets one place; an equal seed and input give equal
cells. Repeated rows are shuffled apart like any others. An empty table gives no rows. The shuffle adds
``shard`` and ``slot``, and its own columns carry a prefix no input should use (``__shuffle_``); a clash raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import shared_folder, staged

SMALL_DRAW = 10 ** 9  # the library's draws are exact up to here


def draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones are in a sample without replacement."""
    if good + bad < SMALL_DRAW:
        return int(rng.hypergeometric(good, bad, sample))
    # Inversion over all counts within 40 deviations of the mode, by ratios of neighbouring probabilities.
    total = good + bad
    mode = (sample + 1) * (good + 1) // (total + 2)
    reach = 40 * (isqrt(max(1, sample * good // total)) + 1)
    low, high = max(0, sample - bad, mode - reach), min(good, sample, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((sample - k) / (bad - sample + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split(rng: np.random.Generator, room: np.ndarray, sample: int) -> np.ndarray:
    """Multivariate: how a sample of all places in ``room`` falls on its entries."""
    out, rest = np.zeros_like(room), int(room.sum())
    if rest < SMALL_DRAW:
        return rng.multivariate_hypergeometric(room, sample, method="marginals")
    for i, here in enumerate(room):
        rest -= int(here)
        out[i] = draw(rng, int(here), rest, sample)
        sample -= int(out[i])
    return out


def matrix_row(before: np.ndarray, room: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Row ``partition`` of the matrix. ``before``: rows before each partition, and the total at the end."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, low, high])))
        left = split(rng, room, int(before[middle] - before[low]))
        room, low, high = (left, low, middle) if partition < middle else (room - left, middle, high)
    return room


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def shuffle_shards(docs: DataFrame, shards: int, seed: int = 5, cell_rows: int = 200_000,
                   stage: bool = False) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, gapless from 0 in every shard.

    ``docs`` must give the same partitions whenever it is run, as a scan does; ``stage=True`` writes any other to the
    shared folder first. A task whose partition differs from what was counted raises and never guesses. A cell holds
    at most ``cell_rows`` rows, so that no shard is one task. One number per partition goes to the tasks.
    """
    spark = docs.sparkSession
    if stage:
        docs = staged(docs, "rows", shared_folder(spark))
    if clash := [c for c in docs.columns if c.lower().startswith("__shuffle_") or c.lower() in ("shard", "slot")]:
        raise ValueError(f"columns {clash} clash with those of the shuffle")
    counted = docs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    counts = np.zeros(max((r["p"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["p"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(counts)])
    total = int(before[-1])
    sizes = exact_sizes(total, shards)
    per_shard = max(1, -(-int(sizes.max()) // cell_rows))
    room = np.concatenate([exact_sizes(int(s), per_shard) for s in sizes])
    first_slot = np.concatenate([np.cumsum(c) - c for c in room.reshape(shards, per_shard)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        n = int(counts[partition]) if partition < len(counts) else 0
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1, partition])))
        cells = rng.permutation(np.repeat(np.arange(len(room)), matrix_row(before, room, partition, seed))) if n else room[:0]
        done = 0
        for batch in batches:
            mine = cells[done:done + batch.num_rows]
            if len(mine) < batch.num_rows:
                raise RuntimeError("partitions changed between two runs of the input; use stage=True")
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(mine, pa.int32()), pa.array(first_slot[mine], pa.int64()),
                 pa.array(rng.integers(0, 2 ** 63 - 1, len(mine)), pa.int64())],
                names=[*batch.schema.names, "__shuffle_cell", "__shuffle_start", "__shuffle_order"])
        if done != n:
            raise RuntimeError("partitions changed between two runs of the input; use stage=True")

    schema = T.StructType([*docs.schema.fields, T.StructField("__shuffle_cell", T.IntegerType()),
                           T.StructField("__shuffle_start", T.LongType()), T.StructField("__shuffle_order", T.LongType())])
    dealt = docs.mapInArrow(deal, schema)
    slot = F.row_number().over(Window.partitionBy("__shuffle_cell").orderBy("__shuffle_order")) - 1
    return dealt.select(*docs.columns, F.floor(F.col("__shuffle_cell") / per_shard).cast("int").alias("shard"),
                        (F.col("__shuffle_start") + slot).alias("slot"))


def query(docs: DataFrame, shards: int = 16) -> DataFrame:
    placed = shuffle_shards(docs, shards)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
