from collections import Counter

import numpy as np
import pytest

from courtside.llm.sharding import draw, matrix_row, query, shuffle_shards


def test_rows_of_the_matrix_add_up():
    counts = np.array([5, 0, 17, 100, 3])
    before = np.concatenate([[0], np.cumsum(counts)])
    room = np.array([32, 31, 31, 31])
    rows = np.stack([matrix_row(before, room, p, 7) for p in range(5)])
    assert rows.sum(axis=0).tolist() == room.tolist() and rows.sum(axis=1).tolist() == counts.tolist()


def test_matrix_is_hypergeometric():
    before, room = np.array([0, 4, 8]), np.array([4, 4])
    seen = Counter(int(matrix_row(before, room, 0, seed)[0]) for seed in range(7000))
    for k, ways in enumerate((1, 16, 36, 16, 1)):
        assert abs(seen[k] / 7000 - ways / 70) < 0.02


def test_large_draws_have_the_right_mean_and_spread():
    rng = np.random.default_rng(1)
    good, bad, sample = 3 * 10 ** 9, 10 ** 9, 10 ** 6
    got = np.array([draw(rng, good, bad, sample) for _ in range(300)])
    assert abs(got.mean() - 750_000) < 120 and 380 < got.std() < 490
    assert draw(rng, 2 * 10 ** 9, 5, 2 * 10 ** 9) in range(2 * 10 ** 9 - 5, 2 * 10 ** 9 + 1)


def test_every_row_gets_one_gapless_place(spark):
    rows = [(i if i % 10 else None, "same" if i % 3 == 0 else f"é{i}" * (i % 50)) for i in range(1003)] + [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = shuffle_shards(docs, 16, cell_rows=20, stage=True)
    got = placed.collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16)) and sum(map(len, by.values())) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in placed.collect()}
    assert len(again) == len(rows)


def test_digest_and_small_tables(spark):
    docs = spark.createDataFrame([(1, "aé", 3), (2, None, 4)], "doc_id long, text string, law int").coalesce(1)
    got = {r["doc_id"]: r for r in query(docs).collect()}
    assert got[1]["size"] == 4 and got[2]["size"] == 1 and got[2]["text_crc32"] == 0 and got[1]["law"] == "rows"
    assert query(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shuffle_shards(docs.withColumn("shard", docs["law"]), 4)
