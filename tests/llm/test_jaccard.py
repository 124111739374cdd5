import random
import re

from courtside.llm.components import component_labels
from courtside.llm.jaccard import jaccard_groups, keep_first, query

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        k = min(n, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc if doc is not None else -1, len(s), least.get(root(i), -1)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    line = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 12, 40, 150]))
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            texts.append(text.upper() if rng.random() < 0.1 else text)
    texts += [line + " " + " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30]))) for _ in range(40)]
    texts += ["", None, " \t\n", "same words here", "Same  words\nhere", "É x y z", "é x y z"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def test_groups_are_those_of_all_pairs(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(4)
        assert got(query(docs)) == brute(rows)


def test_large_group_of_near_copies_is_one(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(80)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(80)] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(query(docs)) == brute(rows)


def test_other_sizes_nulls_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "alone here"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert got(jaccard_groups(docs, n=5, percent=80)) == brute(rows, 5, 80)
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in keep_first(docs).collect())
    assert kept == sorted([(1, "a b c d e f g"), (-1, "a b c d e f g"), (-1, "alone here"), (2, ""), (3, "")])
    assert query(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 300), (5, 5)]
    labels = component_labels(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "cc"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 300: 300, 301: 300}
    empty = component_labels(spark.createDataFrame([], "a long, b long"), str(tmp_path / "none"))
    assert empty.count() == 0


def test_many_components_in_one_bucket(spark, monkeypatch):
    """A family of near copies most of which are linked with few others or none; clusters whole, by buckets and in blocks."""
    from courtside.llm import jaccard

    rng = random.Random(6)
    base = [f"v{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(60)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, text) for i, (_, text) in enumerate(corpus(8))]
    expected = brute(rows)
    assert len({c for _, _, c in expected[:600]}) > 300
    for cluster, block in ((2000, 4096), (8, 4096), (8, 40)):
        monkeypatch.setattr(jaccard, "CLUSTER", cluster)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert got(query(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == expected


def counted(monkeypatch):
    """Rows of every table that the join writes."""
    from courtside.llm import jaccard

    seen, write = {}, jaccard.staged

    def staged(df, name, folder=None):
        out = write(df, name, folder)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", staged)
    return seen


def test_sketches_lose_no_link():
    import numpy as np

    from courtside.llm.jaccard import possible_pairs, sketch

    rng = np.random.default_rng(7)
    for percent in (40, 80, 85, 95):
        sets = []
        for size in (1, 2, 5, 40, 64, 65, 128, 130, 500):
            base = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
            for _ in range(5):
                own = rng.integers(0, 2 ** 63, rng.integers(0, size // 8 + 1), dtype=np.uint64)
                sets.append(np.unique(np.concatenate([base[rng.random(size) < 0.97], own, base[:1]])))
        label = rng.integers(0, 30, len(sets))
        joined = possible_pairs([sketch(s) for s in sets], np.array([len(s) for s in sets]), label, percent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and label[i] != label[j]:
                    assert joined[i] == joined[j]
        assert percent < 80 or len(set(joined.tolist())) >= 9


def test_sets_that_only_share_passages_are_not_sent(spark, monkeypatch):
    """All n-grams are shared and the buckets touch, so that they are one cluster; sets are sent for the one family only."""
    from itertools import combinations

    from courtside.llm import jaccard

    rng = random.Random(9)
    passages = [" ".join(f"p{i}x{rng.randrange(10 ** 6)}" for _ in range(30)) for i in range(9)]
    rows = [(i, " ".join(some)) for i, some in enumerate(combinations(passages, 3))]
    rows.append((500, rows[3][1] + " more"))
    monkeypatch.setattr(jaccard, "CLUSTER", 8)
    seen = counted(monkeypatch)
    assert got(query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)
    assert seen["open"] > 84 and seen["parts"] == 2 * jaccard.FRAGMENTS


def test_exact_copies_give_no_entries(spark, monkeypatch):
    """Six copies of texts that have nothing in common: no n-gram of theirs is one that several texts hold."""
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(50)) for _ in range(30)] + ["", None]
    rows = [(i if i != 40 else None, texts[i % 32]) for i in range(192)]
    seen = counted(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(query(docs)) == brute(rows)
    assert seen["entries"] == len(rows)


def test_shuffles_of_a_written_table_go(spark):
    import time

    from courtside.llm.common import staged

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
        return {x for x in blocks.split(",") if x.startswith("shuffle_")}

    before = shuffles()
    staged(spark.range(1000).repartition(3, "id"), "rows")
    until = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffles() - before
