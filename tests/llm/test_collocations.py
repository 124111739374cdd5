import random
import re
from collections import Counter

import pytest

from courtside.llm import collocations


def brute(rows, least=10, top=2000, percent=50):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = [w for w in re.split(rb"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in candidates.items()):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def prose(seed, n=300):
    rng = random.Random(seed)
    words = ["der", "Die", "das", "été", "Ört", "x", "y y", "of the", "New York City", "new york", "a a a a", "naïve\tuse", "ÀB", "z" * 50]
    words += [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "!  ", "\x0b"]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]
    rows += [(1000 + i, "the same line again, the same line again", "en") for i in range(50)]
    return rows + [(2000, None, "en"), (2001, "", "fr"), (2002, " \t ..", None), (None, "of the " * 30, "en"), (3, rows[3][1], rows[3][2]),
                   (2003, "long " * 3000, "de")]


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting_all(spark, seed):
    rows = prose(seed)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, key string, n int").repartition(7)
    assert found(collocations.query(df)) == brute(rows)


def test_small_runs_memory_and_ranges(spark, monkeypatch):
    for name, value in (("RUN", 500), ("SEEN", 20), ("RANGE_BYTES", 1 << 10)):
        monkeypatch.setattr(collocations, name, value)
    rows = prose(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert found(collocations.collocations(df, least=3, top=20)) == brute(rows, least=3, top=20)


@pytest.mark.parametrize("sample", [1, 10 ** 9])
def test_border_failures_are_made_good(spark, monkeypatch, sample):
    """A sample of everything, and one of nothing: then words, pairs and triples fail one after the other."""
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    monkeypatch.setattr(collocations, "SAMPLE_LEAST", 1)
    rows = prose(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    counts = collocations.frequent_phrases(df)
    assert counts.filter("size > 0").groupBy("key").count().filter("count > 1").isEmpty()      # counted whole in one pass
    assert found(collocations.query(df)) == brute(rows)


def test_scores_beyond_64_bits(spark):
    rows = [(i, "big pair " * 20000, "en") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert found(collocations.query(df)) == brute(rows)


def test_empty(spark):
    for rows in ([], [(1, None, None)], [(1, "a b c", "en")]):
        assert collocations.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() == []
