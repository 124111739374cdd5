import random

import numpy as np
import pyarrow as pa
import pytest

from courtside.llm import chosen_path, overlaps
from courtside.llm.jaccard import gram_set
from tests.llm.test_jaccard import brute, corpus, got

SCHEMA = "doc_id long, text string, node string, size int, path string"


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)


def family(seed, count, words=120, edits=6):
    """A large group of near copies: most are near to few others only."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    rows += [(5000 + i, t) for i, t in enumerate(family(seed, 200))]
    rows += [(None, rows[3][1]), (None, "alone in the wide world it is"), rows[5], (rows[7][0], rows[9][1])]
    found = chosen_path.query(frame(spark, rows))
    assert got(found) == brute(rows, 5, 85)
    for r in found.collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("node,deepest,group", [(40, 10, 8), (12, 2, 8), (6, 1, 2)])
def test_small_leaves_deep_trees_and_blocks(spark, monkeypatch, node, deepest, group):
    for name, value in (("NODE", node), ("DEEPEST", deepest), ("GROUP", group)):
        monkeypatch.setattr(chosen_path, name, value)
    rows = corpus(4) + [(5000 + i, t) for i, t in enumerate(family(4, 300))] + [(6000 + i, "one text many times over and over") for i in range(300)]
    expected, found = brute(rows, 5, 85), got(chosen_path.query(frame(spark, rows)))
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert sum(a != b for a, b in zip(found, expected)) <= 0.005 * len(rows)


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs of exactly 0.85 among documents that share a passage, so that leaves are reached after several levels."""
    monkeypatch.setattr(chosen_path, "NODE", 16)
    rng, rows, pairs = random.Random(9), [], 150
    passage = [f"p{i}" for i in range(60)]
    for i in range(pairs):
        own = [f"o{i}_{j}" for j in range(115)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:-14] + [f"q{i}"]))]
    sets = [set(gram_set(t, 5).tolist()) for _, t in rows]
    shares = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(pairs)]
    assert 0.85 <= min(shares) and max(shares) < 0.93
    found = {r["doc_id"]: r["component_id"] for r in chosen_path.query(frame(spark, rows)).collect()}
    assert all(found[2 * i] == 2 * i for i in range(pairs))
    assert sum(found[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.99 * pairs


def test_runs_never_part_a_key():
    rng = random.Random(3)
    for _ in range(200):
        keys = sorted(rng.randrange(-6, 6) for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(keys) + 1), min(3, len(keys))))
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(part, pa.int64())})
                   for part in (keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)]))]
        out = [b.column("key").to_pylist() for b in overlaps.sorted_runs(iter(batches), "key")]
        assert [k for part in out for k in part] == keys and all(out)
        assert sum(len(set(part)) for part in out) == len(set(keys))


def test_links_in_several_products(monkeypatch):
    monkeypatch.setattr(overlaps, "COLUMNS", 7)
    rng = random.Random(5)
    for _ in range(30):
        pool = rng.sample(range(10 ** 6), 60)
        sets = [np.array(sorted(rng.sample(pool, rng.randrange(30, 55))), "<u8") for _ in range(12)]
        a, b = chosen_path._links(sets, 70)
        expected = {(i, j) for i in range(12) for j in range(i + 1, 12)
                    if 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 70 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}
        assert set(zip(a.tolist(), b.tolist())) == expected


def test_empty(spark):
    assert chosen_path.query(frame(spark, [], 1)).collect() == []
    rows = [(1, None), (2, ""), (None, " \t"), (3, "a"), (None, "b c")]
    assert got(chosen_path.query(frame(spark, rows))) == brute(rows, 5, 85)
    assert {(r["doc_id"], r["kept"]) for r in chosen_path.query(frame(spark, rows)).collect()} == {(1, True), (2, True), (3, True), (None, True)}
