import math
import random

import pytest
from pyspark.sql import functions as F

import courtside.llm.topk as topk


def brute(rows, k):
    finite = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in finite:
        if i % 50 == 0:
            asked[i] = max(v, asked.get(i, v))
    out = set()
    for q, a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in finite if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def numbers(df):
    return {tuple(r) for r in df.collect()}


def vectors(seed, n=700, dims=20):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 7 == 0 else 1) for _ in range(dims)]) for i in rng.sample(range(2000), n)]
    rows += [(3000 + i, [0.5] * dims) for i in range(60)]  # one common vector
    rows += [(50, None), (5001, [1.0, None]), (5002, [float("nan")] * dims), (5003, [float("inf")] * dims), (None, [1.0] * dims),
             (5004, [1.0] * 3), (5005, []), (rows[0][0], rows[0][1]), (5050, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    assert numbers(topk.query(df)) == brute(rows, 5)


def test_large_numbers_stay_exact(spark):
    rows = [(i * 50, [400_000.0 + i, -400_000.0 + i, 0.25 * i]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert numbers(topk.query(df)) == brute(rows, 5)
    with pytest.raises(Exception):
        topk.query(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert numbers(topk.top_k(df, F.col("vec_id") == 0)) == {(0, 1, 1, 131072)}
    assert topk.query(df.limit(0)).count() == 0
    assert topk.query(df.filter("vec_id = 1")).count() == 0
