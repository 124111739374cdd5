import math
import random

import numpy as np
import pytest

from courtside.llm import whitening


def brute(rows, k=8):
    """Sums by plain integers, components by numpy's own solver."""
    good = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    d = max(set(lengths), key=lambda x: (lengths.count(x), x))
    good = [(i, v) for i, v in good if len(v) == d]
    n, sums = len(good), [sum(v[j] for _, v in good) for j in range(d)]
    y = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for _, v in good])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (row @ vectors / np.sqrt(values)).tolist())
           for (i, v), row in zip(good, y)]
    return n, out, values / np.trace(y.T @ y / n)


def vectors(seed, n=400, d=12):
    rng = random.Random(seed)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    rows = [(i, (np.array([rng.gauss(0, 2 / (j + 1)) for j in range(d)]) @ turn).tolist()) for i in range(n)]
    rows += [(n + i, [0.25] * d) for i in range(100)]                       # one common vector
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, []), (902, [1.0] * 3), (903, [None] * d),
                   (904, [float("nan")] * d), (905, [float("inf")] + [0.0] * (d - 1))]


@pytest.mark.parametrize("seed,d", [(1, 12), (2, 12), (3, 5)])
def test_equals_the_dense_solver(spark, seed, d):
    rows = vectors(seed, d=d)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string")
    n, expected, explained = brute(rows)
    found = whitening.query(df.repartition(5)).collect()
    k = min(8, d)
    assert len(found) == k * len(expected)
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    by_row = {}
    for r in found:
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    assert sorted(by_row, key=str) == sorted({(i, s) for i, s, _ in expected}, key=str)
    sign = {}
    for i, s, w in expected:
        for component, value in by_row[i, s]:
            other = w[component - 1]
            if abs(other) > 1e-6:
                assert sign.setdefault(component, np.sign(value * other)) == np.sign(value * other)
            assert abs(value) == pytest.approx(abs(other), abs=1e-8)


def test_counts_equal_the_spectrum():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 40):
        for _ in range(20):
            a = rng.integers(-3, 4, (d, d)).astype(float)
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for shift in rng.uniform(-12, 12, 10):
                if np.abs(values - shift).min() > 1e-9:
                    assert whitening.count_above(a, shift) == (values > shift).sum()


def test_equal_and_close_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((10, 10)))[0]
    for values in ([9, 9, 9, 4, 4, 1, 1, 1, 1, 1], [5, 5 * (1 + 1e-13), 3, 3 * (1 + 1e-9), 2, 1, .5, .25, 0, 0], [1] + [0] * 9, [0] * 10):
        v = turn @ np.diag(values) @ turn.T
        v = (v + v.T) / 2
        found, basis, slices = whitening.leading(v)
        wanted = sorted([x for x in values if x > 0], reverse=True)[:8]
        assert found == pytest.approx(wanted, rel=1e-12)
        assert np.abs(basis.T @ basis - np.eye(len(wanted))).max(initial=0) < 1e-12
        assert np.abs(v @ basis - basis * found).max(initial=0) < 1e-12
        for number, (low, high) in enumerate(slices):                       # the counts certify the numbering
            assert whitening.count_above(v, high * (1 + 1e-12)) <= number < whitening.count_above(v, low * (1 - 1e-12))


def test_hard_spectra():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        d = int(rng.integers(2, 70))
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        values = np.sort(10.0 ** rng.uniform(-3, 3, d))[::-1]
        v = turn @ np.diag(values) @ turn.T
        v = (v + v.T) / 2
        found, basis, _ = whitening.leading(v)
        assert found == pytest.approx(np.linalg.eigvalsh(v)[::-1][:8], rel=1e-9)
        assert np.abs(v @ basis - basis * found).max() < 1e-11 * values[0]


def test_sums_are_exact_beyond_doubles(spark):
    rows = [(i, [float(x), 1.0 - x]) for i, x in enumerate([3e5, 3.1e5, -2e5, 17.0, 2.5e8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, expected, _ = brute(rows)
    found = {(r["vec_id"], r["deviation"]) for r in whitening.query(df).collect()}
    assert found == {(i, s if s < 1 << 63 else None) for i, s, _ in expected}


def test_huge_entries_and_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    huge = whitening.query(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 5.0])], schema)).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and {r["deviation"] for r in huge} == {None}
    assert all(math.isfinite(r["whitened"]) for r in huge)
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert whitening.query(spark.createDataFrame(rows, schema)).collect() == []
    pair = whitening.query(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in pair) == [(1, 1, 1, 1), (2, 1, 1, 1)]
