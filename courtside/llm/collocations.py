"""Operator 13: collocations by Toivonen's mining.

1. *Sample.* A quarter of the rows, told by a hash, proposes words and word pairs that are frequent there at a lowered threshold.
2. *Full pass.* All rows are counted: the proposed phrases and their negative border, that is every word, every pair of proposed
   words and every triple of two proposed pairs. Whether a phrase belongs to them is asked of bitmaps of fixed size; a wrong yes
   counts a phrase too many, never one too few.
3. *Failures.* Phrases of the border that turn out frequent join the proposals; an expansion pass counts what this makes
   new in the border, and so on until no border phrase fails. Every phrase is counted whole in one of the passes.
4. *Scores.* A counted pair carries the names of its words, a triple those of its first pair and its last word. So cuts, scores and
   containment are joins of the counts. A last pass writes out in words what reaches the rank of the last row asked for, ties
   included; the words then decide among these.

Counts travel as runs of 64-bit names, one row for each flush of a task, language and range of names, added up range by range. The
number of ranges follows the bytes of the texts. Only frequent phrases become rows.

Contract. Null and empty texts have no words, a null ``lang`` is ``und``; a literal ``und`` is the same. Repeated rows count each time.
Equal scores and counts are told apart by the phrase. A language without a candidate, as an empty table, gives no rows. No phrase
crosses a piece or a row. Texts are read whole; a task holds a row and its names at once. Phrases of a language are told apart by
64 bits. Other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import discard, need, shared_folder, slices, staged, trim
from courtside.llm.hashing import follow, mix, segment_hashes, segments
from courtside.llm.jaccard import _bitmap, _has

BITS = 26               # 8 MB a bitmap, whatever the corpus
RUN = 1 << 21           # names a task adds up at once
RANGE_BYTES = 1 << 24   # of text for each range of names
LEAST_RANGES = 16
SEEN = 1 << 20          # phrases a task remembers to have written out
SAMPLE, SAMPLE_LEAST = 4, 2
RANKED = 64             # parts of a language in the first ranking


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x09]] = 1
    out[list(b".,;:!?\n\x0b\x0c\r")] = 2
    return out


_KIND = _kinds()


class _Words:
    """The words of some rows of one language: their names, and which of them are followed by another of the same piece."""

    def __init__(self, texts: list[str], lang: str):
        self.raw = np.frombuffer(b"\n".join(t.encode() for t in texts).lower(), np.uint8)
        kind = _KIND[self.raw]
        inside = kind == 0
        self.starts, self.ends = segments(inside)
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        self.one = mix(segment_hashes(self.raw, inside, self.starts, self.ends) ^ salt)
        piece = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        near = np.flatnonzero(piece[1:] == piece[:-1])
        self.pairs = near                                                     # places of the first words
        self.two = follow(self.one[near], self.one[near + 1])
        self.first = np.flatnonzero(np.diff(near) == 1)                       # places in `pairs` that the next one follows
        self.three = follow(self.two[self.first], self.one[near[self.first] + 2])

    def phrase(self, place: int, size: int) -> str:
        words = (self.raw[a:b].tobytes() for a, b in zip(self.starts[place:place + size], self.ends[place:place + size]))
        return b" ".join(words).decode()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Words]]:
    for batch in batches:
        for rows in slices(batch):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                if text:
                    texts.setdefault("und" if lang is None else lang, []).append(text)
            for lang, held in texts.items():
                yield lang, _Words(held, lang)


def _eligible(words: _Words, ones: bytes, twos: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have proposed words, and which triples proposed pairs."""
    one, two = (np.frombuffer(b, np.uint8) for b in (ones, twos))
    known = _has(one, BITS, words.one)
    pair = _has(two, BITS, words.two)
    return known[words.pairs] & known[words.pairs + 1], pair[words.first] & pair[words.first + 1]


_RUNS = "part long, lang string, left binary, right binary, counts binary"
_COUNTS = "lang string, size int, key long, left long, right long, n long"


def _counted(ranges: int, now, before, sample: bool):
    """Runs of names, as left and right part of each phrase. ``now`` and ``before``: bitmaps of proposed words and pairs; what was
    eligible before is counted already."""
    def flush(held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for (lang, size), arrays in held.items():
            left, right = (np.concatenate(side) for side in zip(*arrays))
            found, first, n = np.unique(left if size == 0 else follow(left, right), return_index=True, return_counts=True)
            part = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edges = np.append(np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 40))), len(found))
            for a, b in zip(edges[:-1], edges[1:]):
                order = a + np.argsort(n[a:b] > 1, kind="stable")  # what occurs once needs no count
                rows.append((size * ranges + int(part[a]), lang, left[first[order]].astype("<u8").tobytes(),
                             right[first[order]].astype("<u8").tobytes() if size else b"", n[order][n[order] > 1].astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["part", "lang", "left", "right", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for lang, words in _by_language(batches):
            one, two, pairs, first = words.one, words.two, words.pairs, words.first
            if sample:
                some = [np.ones(len(one), bool), np.ones(len(two), bool), np.zeros(len(first), bool)]
            else:
                some = [np.full(len(one), before is None), *_eligible(words, *now.value)]
                if before is not None:
                    some[1:] = [new & ~old for new, old in zip(some[1:], _eligible(words, *before.value))]
            new = [(one[some[0]], one[some[0]]), (one[pairs[some[1]]], one[pairs[some[1]] + 1]),
                   (two[first[some[2]]], one[pairs[first[some[2]]] + 2])]
            for place, sides in enumerate(new):
                if len(sides[0]):
                    held.setdefault((lang, place), []).append(sides)
                    size += len(sides[0])
            if size >= RUN:
                yield flush(held)
                held, size = {}, 0
        if size:
            yield flush(held)
        trim()
    return run


def _added(ranges: int, least: int):
    """The frequent phrases of one range and language, and a row without a key of the number of words in it."""
    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("part")[0].as_py() // ranges + 1
        left, right, n = [], [], []
        for a, b, counts in zip(*(rows.column(c).to_pylist() for c in ("left", "right", "counts"))):
            left.append(np.frombuffer(a, "<u8"))
            right.append(np.frombuffer(b, "<u8") if size > 1 else left[-1])
            several = np.frombuffer(counts, "<u4")
            n.append(np.append(np.ones(len(left[-1]) - len(several), np.int64), several.astype(np.int64)))
        left, right, n = np.concatenate(left), np.concatenate(right), np.concatenate(n)
        keys = left if size == 1 else follow(left, right)
        order = np.argsort(keys)
        starts = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        total = np.add.reduceat(n[order], starts)
        held = total >= least
        at = order[starts[held]]
        more = [int(n.sum())] if size == 1 else []
        found = len(at) + len(more)

        def column(values: np.ndarray) -> pa.Array:
            return pa.concat_arrays([pa.array(values.view(np.int64)), pa.nulls(len(more), pa.int64())])

        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * found, pa.string()),
                         "size": pa.array([size] * len(at) + [0] * len(more), pa.int32()), "key": column(keys[at]),
                         "left": column(left[at]), "right": column(right[at]), "n": pa.array(total[held].tolist() + more, pa.int64())})
    return run


def _count(texts: DataFrame, ranges: int, least: int, folder: str, name: str, now=None, before=None) -> DataFrame:
    """The phrases that one pass counts and that occur often enough."""
    runs = texts.mapInArrow(_counted(ranges, now, before, now is None), _RUNS)
    return staged(runs.groupBy("part", "lang").applyInArrow(_added(ranges, least), _COUNTS), name, folder)


def _proposed(counts: DataFrame, old: tuple[bytes, bytes] | None) -> tuple[bytes, bytes]:
    """The bitmaps of the frequent words and pairs, together with those before."""
    new = [_bitmap(counts.filter(F.col("size") == size), "key", BITS) for size in (1, 2)]
    if old:
        new = [(np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(new, old)]
    return new[0], new[1]


def _written(chosen):
    """(key, phrase) of the pairs and triples of a bitmap, about once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(chosen.value, np.uint8), np.zeros(0, np.uint64)
        for _, words in _by_language(batches):
            keys, phrases = [], []
            for size, names in ((2, words.two), (3, words.three)):
                there = np.flatnonzero(_has(bitmap, BITS, names))
                found, first = np.unique(names[there], return_index=True)
                new = ~np.isin(found, seen)
                seen = np.concatenate([seen, found[new]])
                places = words.pairs[there[first[new]] if size == 2 else words.first[there[first[new]]]]
                keys.append(found[new].view(np.int64))
                phrases.extend(words.phrase(place, size) for place in places.tolist())
            if len(seen) > SEEN:
                seen = seen[:0]
            if phrases:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(phrases, pa.string())], names=["key", "phrase"])
    return run


def frequent_phrases(docs: DataFrame, least: int = 10, folder: str | None = None) -> DataFrame:
    """(lang, size, key, left, right, n): words, pairs and triples that occur ``least`` times in their language, with the names of
    their parts; the rows of size 0 add up to the number of words of a language."""
    spark = docs.sparkSession
    context, folder = spark.sparkContext, folder or shared_folder(spark)
    texts = need(docs, "lang", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, size // RANGE_BYTES)
    sample = need(docs, "doc_id", "lang", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    bitmaps = _proposed(_count(sample.select("lang", "text"), ranges, SAMPLE_LEAST, folder, "sample"), None)
    shared, counts, number = [], None, 0
    while True:
        shared.append(context.broadcast(bitmaps))
        more = _count(texts, ranges, least, folder, f"pass_{number}", shared[-1], shared[-2] if number else None)
        counts = more if counts is None else counts.unionByName(more)
        grown = _proposed(more, bitmaps)
        if grown == bitmaps:  # no border phrase failed
            break
        bitmaps, number = grown, number + 1
    for bitmap in shared:
        bitmap.destroy()
    return counts


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of the last two words of each triple."""
    for batch in batches:
        second, third = (batch.column(c).to_numpy().view(np.uint64) for c in ("second", "third"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "a", "first", "start", "third")),
                                          pa.array(follow(second, third).view(np.int64))],
                                         names=["key", "a", "first", "start", "third", "rest"])


def _lowest(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, best) of cuts (key, a, k, left, right): the lowest score, its cut and the counts of the parts."""
    left, right = (counts.select(F.col("key").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    wide, million = "decimal(15,0)", F.lit(1000000).cast("decimal(7,0)")
    scored = cuts.join(left, "left").join(right, "right").withColumn("over", million * F.col("a").cast(wide) * F.col("a").cast(wide)).withColumn(
        "under", F.col("l").cast(wide) * F.col("r").cast(wide)).withColumn("score", F.expr("over div under"))
    return scored.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    counts = frequent_phrases(docs, least, folder)
    totals = counts.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    parts = counts.filter("size in (1, 2)").select("key", "n")
    pairs = counts.filter("size = 2").select("lang", "key", "left", "right", F.col("n").alias("a"))
    triples = counts.filter("size = 3").select("lang", "key", F.col("left").alias("start"), F.col("right").alias("third"), F.col("n").alias("a"))
    words = pairs.select(F.col("key").alias("start"), F.col("left").alias("first"), F.col("right").alias("second"))
    triples = staged(triples.join(words, "start").mapInArrow(_inner, "key long, a long, first long, start long, third long, rest long"),
                     "triples", folder)
    cuts = pairs.select("key", "a", F.lit(1).alias("k"), "left", "right").unionByName(
        triples.select("key", "a", F.lit(1).alias("k"), F.col("first").alias("left"), F.col("rest").alias("right"))).unionByName(
        triples.select("key", "a", F.lit(2).alias("k"), F.col("start").alias("left"), F.col("third").alias("right")))
    longer = triples.select(F.col("a").alias("most"), F.explode(F.array("start", "rest")).alias("key")).groupBy("key").agg(F.max("most").alias("most"))
    candidates = counts.filter("size in (2, 3)").select("lang", "key", F.col("n").alias("a"))
    kept = candidates.join(longer, "key", "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    rows = kept.join(_lowest(cuts, parts), "key").select("lang", "key", "a", "best.l", "best.r", "best.score", F.xxhash64("key").alias("part"))

    order = [F.desc("score"), F.desc("a")]
    some = Window.partitionBy("lang", F.pmod("part", F.lit(RANKED))).orderBy(*order)
    rows = rows.withColumn("place", F.rank().over(some)).filter(F.col("place") <= top).drop("place", "part")
    rows = rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    rows = staged(rows.drop("place"), "chosen", folder)
    chosen = spark.sparkContext.broadcast(_bitmap(rows.select("key"), "key", BITS))
    phrases = need(docs, "lang", "text").mapInArrow(_written(chosen), "key long, phrase string").distinct()
    named = rows.join(phrases, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))))
    result = staged(named.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    chosen.destroy()
    discard(spark, folder)
    return result


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(
             translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM w WHERE len(w) > 1
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM w WHERE len(w) > 2),
f AS (SELECT lang, size, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
             CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, MAX(a) AS most FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY ALL)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS BIGINT) AS rank, b.phrase, b.a, l, r, t.n, score
FROM b JOIN t USING (lang) LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase
WHERE d.most IS NULL OR 100 * d.most < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
