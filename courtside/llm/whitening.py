"""Operator 11: whitening of embeddings by spectrum slicing.

1. *Sums.* Entries become integers, so counts, sums and products about an integer centre are added exactly, first in each
   task, then by Spark; the driver gets one number per dimension and one per pair of dimensions, whatever the rows.
2. *Slicing.* Eigenvalues of ``V - s I`` above zero are counted in an LDL' factorisation with 1x1 and 2x2 pivots (inertia).
   Bisection on the counts isolates each of the leading eigenvalues, or a group of them that no double can part.
3. *Rayleigh quotient iteration* from inside the slice finds the eigenpair; it counts only if its value lies in the slice,
   else the slice is halved and the iteration starts anew. Counts on both sides of the value certify its number.
4. *Projection.* Each task projects its rows; the covariance of what came out is measured in a pass of its own.

Contract. Rows whose vector is null or holds null or non-finite entries are left out, so are vectors whose length is not the
commonest one (ties: the longer). Repeated rows count each time, a null ``vec_id`` takes part and stays null. Directions without
variance have no component: all of them in a table of equal vectors, which gives no rows, as does an empty one. Entries beyond
``2 ** 62`` once scaled are held there; beyond ``2 ** 40`` from the centre products are added as doubles. A deviation beyond a
long is null. Equal eigenvalues share their space, with any orthonormal basis of it, the same for all rows. Other columns are
never touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import need

SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 62)
EXACT = 1 << 40        # differences from the centre up to which products are added as integers
SLICE = 4096           # rows that a task multiplies at once
EPS = float(np.finfo(float).eps)


class Whitening(NamedTuple):
    """Statistics and components: ``basis`` is dimensions x components, ``values`` fall, ``slices`` hold each one's proof."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    slices: list[tuple[float, float]]

    @property
    def centre(self) -> list[int]:
        return [round(s / self.n) if abs(s) < 1 << 53 else s // self.n for s in self.sums]


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scaled integers of the vectors of that length without null or non-finite entries."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    held = np.maximum(sizes, 0)
    values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == length)
    rows = values[(np.cumsum(held) - held)[places][:, None] + np.arange(length)]
    good = np.isfinite(rows).all(1)
    scaled = np.clip(np.floor(rows[good] * SCALE), -LIMIT, LIMIT)
    return places[good], scaled.astype(np.int64) + OFFSET


def _add(total, more: np.ndarray, bound: int, rows: int):
    """Exact column sums of integers no larger than ``bound``."""
    return total + (more.sum(0) if bound * rows < 1 << 62 else more.astype(object).sum(0)).astype(object)


def _bound(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column("vector")
        for length in pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist():
            _, x = _matrix(column, length)
            held = found.setdefault(length, [0, np.zeros(length, object)])
            held[0] += len(x)
            held[1] = _add(held[1], x, _bound(x), len(x))
    for length, (n, sums) in found.items():
        yield pa.RecordBatch.from_pydict(
            {"length": [length] * length, "i": list(range(length)), "n": [n] * length,
             "total": pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))},
            schema=pa.schema([("length", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))


def _products(length: int, centre: list[int], exact: bool):
    """Sums of the products of all pairs of dimensions, of differences from an integer centre."""
    i, j = np.triu_indices(length)
    kind = pa.decimal128(38, 0) if exact else pa.float64()
    at = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length), object if exact else float)
        for batch in batches:
            _, x = _matrix(batch.column("vector"), length)
            x = x - at
            bound = _bound(x)
            rows = min(SLICE, max(1, (1 << 53) // max(1, bound * bound))) if exact else SLICE
            for start in range(0, len(x), rows):
                part = x[start:start + rows]
                if not exact or bound * bound < 1 << 53:  # every sum is an integer that a double holds
                    part = part.astype(float)
                    total = total + ((part.T @ part).astype(np.int64).astype(object) if exact else part.T @ part)
                else:
                    part = part.astype(object)
                    total = total + np.outer(part[0], part[0])
        value = pa.array([Decimal(int(v)) for v in total[i, j]], kind) if exact else pa.array(total[i, j], kind)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), value], names=["i", "j", "total"])
    return run


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``v`` above ``shift``: the positive pivots of ``v - shift I = L D L'`` (Bunch and Kaufman)."""
    a = v - shift * np.eye(len(v))
    tiny, ratio, count = EPS * max(np.abs(v).max(initial=0.0), abs(shift), 1e-300), (1 + 17 ** 0.5) / 8, 0
    while len(a):
        below = np.abs(a[1:, 0])
        r = int(below.argmax()) + 1 if len(below) else 0
        largest = below[r - 1] if r else 0.0
        row = np.abs(np.delete(a[r], r)).max() if r else 0.0
        if max(abs(a[0, 0]), largest) <= tiny:
            pivot = 1                                    # a zero pivot: no eigenvalue above the shift that can be told
        elif abs(a[0, 0]) >= ratio * largest or abs(a[0, 0]) * row >= ratio * largest ** 2:
            pivot = 1
        elif abs(a[r, r]) >= ratio * row:
            a = _swapped(a, 0, r)
            pivot = 1
        else:
            a = _swapped(a, 1, r)
            pivot = 2
        head = a[:pivot, :pivot]
        if pivot == 1:
            count += head[0, 0] > tiny
            rest = a[1:, 1:]
            a = rest - np.outer(a[1:, 0], a[0, 1:]) / head[0, 0] if abs(head[0, 0]) > tiny else rest
        else:
            count += 1                                   # such a block has one value on each side of zero
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(head, a[:2, 2:])
    return int(count)


def _swapped(a: np.ndarray, i: int, j: int) -> np.ndarray:
    order = np.arange(len(a))
    order[[i, j]] = order[[j, i]]
    return a[np.ix_(order, order)]


def _solved(v: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    a = v - shift * np.eye(len(v))
    try:
        return np.linalg.solve(a, right)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a + EPS * np.abs(v).max() * np.eye(len(v)), right)


def leading(v: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """The ``most`` largest eigenvalues of a positive semidefinite matrix, their unit vectors, and a slice for each (or for each
    group too close to part) above which there are as many eigenvalues as come before it."""
    d = len(v)
    top = float(np.abs(v).sum(1).max(initial=0.0))
    floor = 16 * d * EPS * top                           # below it a double cannot tell a value from zero
    total = count_above(v, floor) if top > 0 else 0
    random = np.random.default_rng(11)
    values, vectors, slices = [], [], []
    while len(values) < min(most, total):
        number = len(values)
        low, high = floor, 1.0001 * top                  # more than `number` values above low, `number` above high
        inside = total - number
        while True:
            while inside > 1 and high - low > 8 * EPS * top:
                middle = (low + high) / 2
                above = count_above(v, middle)
                if above > number:
                    low, inside = middle, above - number
                else:
                    high = middle
            pair = _quotient(v, low, high, inside, random, vectors)
            if pair is not None or high - low <= 4 * EPS * top:
                break
            middle = (low + high) / 2
            above = count_above(v, middle)
            low, high, inside = (middle, high, above - number) if above > number else (low, middle, inside)
        found, basis = pair if pair is not None else _space(v, (low + high) / 2, inside, random, vectors)
        values.extend(found)
        vectors.extend(basis.T)
        slices.extend([(low, high)] * len(found))
    count = min(most, total)
    return np.array(values[:count]), np.array(vectors[:count]).reshape(count, d).T, slices[:count]


def _apart(x: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in vectors:
            x = x - np.outer(u, u @ x) if x.ndim == 2 else x - u * (u @ x)
    return x


def _quotient(v: np.ndarray, low: float, high: float, inside: int, random, vectors: list[np.ndarray]):
    """The eigenpair of a slice that holds one, or None if the iteration leaves the slice or the counts do not bear it out."""
    if inside > 1:
        return _space(v, (low + high) / 2, inside, random, vectors)
    x = random.standard_normal(len(v))
    for _ in range(2):                                   # towards the value nearest to the middle
        x = _solved(v, (low + high) / 2, x)
        x = _apart(x / np.linalg.norm(x), vectors)
        x /= np.linalg.norm(x)
    scale = np.abs(v).max()
    for _ in range(12):
        value = float(x @ v @ x)
        if np.linalg.norm(v @ x - value * x) <= 4 * EPS * scale:
            break
        x = _solved(v, value, x)
        x /= np.linalg.norm(x)
    x = _apart(x, vectors)
    x /= np.linalg.norm(x)
    value = float(x @ v @ x)
    slack = 16 * len(v) * EPS * scale
    if not low - slack <= value <= high + slack or np.linalg.norm(v @ x - value * x) > slack:
        return None
    if not count_above(v, value + slack) <= len(vectors) < count_above(v, value - slack):
        return None
    return [value], x[:, None]


def _space(v: np.ndarray, shift: float, inside: int, random, vectors: list[np.ndarray]):
    """The space of a group of eigenvalues that no shift parts, and its Ritz values."""
    x = random.standard_normal((len(v), inside))
    for _ in range(4):
        x, _ = np.linalg.qr(_apart(_solved(v, shift, x), vectors))
    small, turn = np.linalg.eigh(x.T @ v @ x)
    return list(small[::-1]), x @ turn[:, ::-1]


def fit(df: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all valid vectors; None if there is none."""
    rows = need(df, column).select(F.col(f"`{column}`").cast("array<double>").alias("vector"))
    sums = rows.mapInArrow(_sums, "length int, i int, n long, total decimal(38,0)").groupBy("length", "i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    longest = sums.filter("i = 0 and n > 0").orderBy(F.desc("n"), F.desc("length")).first()
    if longest is None:
        return None
    d, n = longest["length"], longest["n"]
    totals = [int(r["total"]) for r in sums.filter(F.col("length") == d).orderBy("i").collect()]
    model = Whitening(n, totals, np.zeros((d, 0)), np.zeros(0), 0.0, [])
    at = np.array(model.centre, np.int64)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            _, x = _matrix(batch.column("vector"), d)
            most = max(most, _bound(x.astype(float) - at) if len(x) else 0)
        yield pa.RecordBatch.from_pydict({"most": pa.array([min(most, 1 << 62)], pa.int64())})

    exact = (rows.mapInArrow(widest, "most long").agg(F.max("most")).first()[0] or 0) < EXACT
    kind = "decimal(38,0)" if exact else "double"
    products = rows.mapInArrow(_products(d, model.centre, exact), f"i int, j int, total {kind}").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    v, rest = np.zeros((d, d)), [s - n * c for s, c in zip(totals, model.centre)]
    for i, j, total in products:
        # (sum y_i y_j - sum y_i sum y_j / n) / n, rounded once
        v[i, j] = v[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n) if exact else total / n - rest[i] / n * (rest[j] / n)
    values, basis, slices = leading(v, components)
    return model._replace(basis=basis, values=values, trace=float(np.trace(v)), slices=slices)


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation, whitened array) of every valid vector."""
    d, n = model.basis.shape[0], model.n
    at = np.array(model.centre, np.int64)
    rest = [s - n * c for s, c in zip(model.sums, model.centre)]
    weights = model.basis / np.sqrt(model.values)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = _matrix(batch.column("vector"), d)
            y = x - at
            bound = n * _bound(y) + max(map(abs, rest), default=0)
            small = bound * bound * max(d, 1) < 1 << 63
            t = n * y - np.array(rest, np.int64) if bound < 1 << 62 else n * y.astype(object) - np.array(rest, object)
            squares = (t * t).sum(1) if small else (t.astype(object) ** 2).sum(1)
            deviation = [int(s) if s < 1 << 63 else None for s in squares]
            out = (t / n).astype(float) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places)), pa.array(deviation, pa.int64()), lists],
                                             names=[key, "deviation", "whitened"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on them."""
    i, j = np.triu_indices(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            x = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            n, sums, products = n + len(x), sums + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()),
             pa.array(sums[i]), pa.array(sums[j]), pa.array(products[i, j])], names=["i", "j", "n", "a", "b", "ab"])

    rows = whitened.select("whitened").mapInArrow(run, "i int, j int, n long, a double, b double, ab double")
    total = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")]).collect()
    return max((abs(r["ab"] / r["n"] - r["a"] / r["n"] * (r["b"] / r["n"]) - (r["i"] == r["j"])) for r in total), default=0.0)


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def query(embeddings: DataFrame) -> DataFrame:
    model = fit(embeddings)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    rows = transform(embeddings, model)
    error = identity_error(rows, len(model.values))
    share = F.array(*[F.lit(float(e) / model.trace) for e in model.values])
    spread = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return spread.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("place") + 1).alias("component"),
                         F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("place")].alias("explained"),
                         F.lit(error).alias("identity_error"))
