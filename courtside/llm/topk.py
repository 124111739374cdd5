"""Operator 7: exact top-k by inner product, columnar branch-and-bound over blocks.

Vectors are stored in blocks of rows, each block dimension by dimension. For a query and a block, scores are accumulated
a few dimensions at a time; after each step the candidates whose partial score plus the largest share that the
remaining dimensions can add (the product of the remaining norms) stays below the query's bound are dropped, and the
survivors are compacted. Bounds begin with a query's k-th best score in one pilot block and rise within a block.

Queries are a stated set. They are in blocks too; each query block meets each candidate block once, and gives its
k best of it. Blocks are of fixed size, so no task holds more than one of each.

Contract. Components become ``floor(256 * x)``. Vectors that are null or hold a null or non-finite component take no part,
nor do rows without ``vec_id``; shorter vectors count as filled up with zeros. Of rows that repeat a query's id the
largest vector asks; as candidates all rows count, but never those with the query's own id. Ties go to the
smaller ``vec_id``. A component beyond 2^27 raises, as its scores may not fit a long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, staged, width

CANDIDATES, QUERIES = 4096, 1024  # rows of a block
STEP = 8                          # dimensions at a time
LARGEST = 1 << 27
_BLOCK = "block int, n int, dims int, ids binary, vectors binary"
_BOUNDED = "block int, n int, dims int, ids binary, vectors binary, bounds binary"
_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of all rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = need(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))

    def number(x: Column) -> Column:
        scaled = x.cast("double") * 256
        return F.when(F.abs(scaled) > LARGEST, F.raise_error(F.lit("a component is too large")).cast("long")).otherwise(F.floor(scaled))

    return rows.select("vec_id", F.transform("embedding", number).alias("vector"))


def _build(table: pa.Table) -> pa.Table:
    vectors = table.column("vector").to_pylist()
    dims = max(map(len, vectors))
    filled = np.zeros((len(vectors), dims), np.int32)
    for i, v in enumerate(vectors):
        filled[i, :len(v)] = v
    ids = table.column("vec_id").combine_chunks().to_numpy().astype(np.int64)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                     "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                     "vectors": pa.array([np.ascontiguousarray(filled.T).tobytes()], pa.binary())})


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, dealt by a row's place in the input, so that no id fills a block."""
    number = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_build, _BLOCK), number


class Block:
    """A block in vertical layout, with the norms of what remains after each step."""

    def __init__(self, n: int, dims: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.columns = np.frombuffer(vectors, np.int32).reshape(dims, n)

    def widened(self, dims: int) -> np.ndarray:
        filled = np.zeros((dims, len(self.ids)), np.int64)
        filled[:len(self.columns)] = self.columns
        return filled


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each step on; a little more than it is, so that rounding never drops a row."""
    squares = np.concatenate([columns.astype(float) ** 2, np.zeros((1, columns.shape[1]))])
    left = np.cumsum(squares[::-1], axis=0)[::-1]
    steps = np.minimum(np.arange(STEP, len(columns) + STEP, STEP), len(columns))
    return np.sqrt(left[steps]) * (1 + 1e-9) + 1e-9


def search(queries: Block, bounds: np.ndarray, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of its best ``k`` rows of the block at or above its bound."""
    dims = max(len(queries.columns), len(block.columns))
    asked, held = queries.widened(dims), block.widened(dims)
    reach = int(np.abs(asked).max(initial=0)) * int(np.abs(held).max(initial=0)) * dims
    if reach >= 1 << 63:
        raise OverflowError("scores do not fit a long")
    if reach < 1 << 53:  # then sums of doubles are exact
        asked, held = asked.astype(float), held.astype(float)
    asked = np.ascontiguousarray(asked.T)
    own_rest, rest = _rest(asked.T), _rest(held)
    first = asked[:, :STEP] @ held[:STEP]
    for q, query in enumerate(asked):
        alive = np.flatnonzero(first[q] + own_rest[0, q] * rest[0] >= bounds[q]) if len(rest) else np.arange(len(block.ids))
        alive = alive[block.ids[alive] != queries.ids[q]]
        score, bound = first[q, alive], bounds[q]
        for step in range(1, len(rest)):
            if not len(alive):
                break
            at = slice(step * STEP, (step + 1) * STEP)
            score = score + query[at] @ held[at, alive]
            open_part = own_rest[step, q] * rest[step, alive]
            if len(alive) > 4 * k and step % 2:
                bound = max(bound, np.partition(score - open_part, -k)[-k] - 1e-6)
            kept = score + open_part >= bound
            alive, score = alive[kept], score[kept]
        score = score.astype(np.int64)
        order = np.lexsort((block.ids[alive], -score))[:k]
        keep = score[order] >= bounds[q]
        yield q, block.ids[alive][order[keep]], score[order[keep]]


def _bounded(pilot: tuple | None, k: int):
    """Adds to query blocks the k-th best score of each query in the pilot block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for n, dims, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("n", "dims", "ids", "vectors"))):
                bound = np.full(n, -np.inf)
                if pilot:
                    for q, _, score in search(Block(n, dims, ids, vectors), bound, Block(*pilot), k):
                        bound[q] = score[-1] if len(score) == k else -np.inf
                bounds.append(bound.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.binary())], names=[*batch.schema.names, "bounds"])
    return run


def _search(k: int):
    names = ["n", "dims", "ids", "vectors", "bounds", "c_n", "c_dims", "c_ids", "c_vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, dims, ids, vectors, bounds, *held = (batch.column(c)[row].as_py() for c in names)
                queries = Block(n, dims, ids, vectors)
                found = list(search(queries, np.frombuffer(bounds), Block(*held), k))
                asked = np.concatenate([np.full(len(f[1]), queries.ids[f[0]]) for f in found]) if found else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.int64()), pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
                     pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.int64())],
                    names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each of its rows for which ``asks``
    holds."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = staged(whole_numbers(vectors), "vectors", folder)
    candidates, number = _blocks(rows, CANDIDATES)
    candidates = staged(candidates, "candidates", folder)
    asked = rows.filter(asks).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    queries, _ = _blocks(asked, QUERIES)
    pilot = candidates.orderBy("block").select("n", "dims", "ids", "vectors").first()  # one block
    queries = queries.mapInArrow(_bounded(tuple(pilot) if pilot else None, k), _BOUNDED)
    met = (queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).repartition(width(spark), "block")
           .join(candidates.select("block", *[F.col(c).alias(f"c_{c}") for c in ("n", "dims", "ids", "vectors")])
                 .repartition(width(spark), "block"), "block"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.drop("block").mapInArrow(_search(k), _FOUND).withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
