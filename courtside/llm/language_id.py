"""Operator 6: language identification by nearest centroid of TF-IDF character n-grams.

A text is the vector of its character bigrams and trigrams inside words, hashed, with weight
``sqrt(count) * idf`` and length 1. Every language has several centroids, found by spherical k-means; the language of
the nearest one by cosine is predicted. Where even the nearest is farther than nearly all training texts of its
own cluster, by far, the prediction is rejected.

*Fit.* Document counts (idf) are summed over all training rows. The centroids are fitted on a sample of
``PER_LANGUAGE`` texts of each language at most, those of smallest hash; ``MOST_LANGUAGES`` bounds the languages.

Contract. A null text, or one without a letter, is ``und`` with score 0 and rejected. Case, digits, marks and white space
play no part. Equal scores go to the language that comes first by name. Rows without text or label are not trained on.
Without any training row everything is ``und``. Repeated rows get equal results. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import need, slices

BITS = 13
DIMS = 1 << BITS
ROWS = 256  # texts whose counts are held at once
PER_LANGUAGE = 400
MOST_LANGUAGES = 1000
CLUSTERS = 4
REJECT = 0.2  # share of the 1 % quantile of a cluster's own cosines below which a text is rejected
FULL = 200    # n-grams from which on a text is judged by that; shorter ones are less like any centroid
CHARS = 1 << 18
_PLANE = 0x3000  # letters up to here are looked up; rarer ones are asked one by one


def _letter(cp: int) -> int:
    ch = chr(cp)
    return ord(ch.lower()[0]) if ch.isalpha() else 0


_LETTERS = np.array([_letter(c) for c in range(_PLANE)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, 0 for all that are no letters."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _LETTERS[np.minimum(cps, _PLANE - 1)]
    high = np.flatnonzero(cps >= _PLANE)
    if len(high):
        kinds, back = np.unique(cps[high], return_inverse=True)
        out = out.copy()
        out[high] = np.array([_letter(int(c)) for c in kinds], np.uint32)[back]
    return out


def count_grams(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed bigrams and trigrams, one row per text. Long texts are counted whole, piece by piece."""
    out = np.zeros((len(texts), DIMS), np.float32)
    block, owners, size = [], [], 0
    gap = np.zeros(1, np.uint32)

    def flush():
        if not block:
            return
        cps = np.concatenate([*block, gap])
        owner = np.concatenate([*owners, [0]])
        mid = np.flatnonzero(cps[1:-1]) + 1
        a, b, c = (cps[mid + k].astype(np.uint64) for k in (-1, 0, 1))
        two = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
        three = ((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
                 + c * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(64 - BITS)
        row = owner[mid] * DIMS
        low, high = int(owner[0]), int(owner[:-1].max())
        keys = np.concatenate([row + two.astype(np.int64), row + three.astype(np.int64)]) - low * DIMS
        counts = np.bincount(keys, minlength=(high - low + 1) * DIMS).reshape(-1, DIMS)
        out[low:high + 1] += counts
        block.clear()
        owners.clear()

    for at, text in enumerate(texts):
        cps = letters(text) if text else gap
        for start in range(0, len(cps), CHARS):
            # A piece takes one letter more on either side; those are no middles of its n-grams.
            piece = cps[start:start + CHARS]
            if len(cps) > CHARS:
                flush()
                out[at] += _count_piece(cps, start)
                continue
            block.extend((gap, piece))
            owners.append(np.full(len(piece) + 1, at))
            size += len(piece)
        if size > CHARS or len(owners) >= 256:
            flush()
            size = 0
    flush()
    return out


def _count_piece(cps: np.ndarray, start: int) -> np.ndarray:
    around = np.concatenate([[0], cps, [0]]).astype(np.uint32)[start:start + CHARS + 2]
    mid = np.flatnonzero(around[1:-1]) + 1
    a, b, c = (around[mid + k].astype(np.uint64) for k in (-1, 0, 1))
    two = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    three = ((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
             + c * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(64 - BITS)
    return np.bincount(np.concatenate([two, three]).astype(np.int64), minlength=DIMS)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.sqrt(counts) * idf.astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]      # of each centroid
    centroids: np.ndarray
    nearest: np.ndarray       # cosine below which a text is too far
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        counts = count_grams(texts)
        some = counts.any(axis=1) & bool(self.languages)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = unit(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)  # the first of equals; centroids are ordered by language
        score = np.where(some, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
        near = self.nearest[best] * np.minimum(1, np.sqrt(counts.sum(axis=1) / FULL))
        return [self.languages[b] if s else "und" for b, s in zip(best, some)], score, ~some | (score < near)


def _kmeans(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from rows that are more and less like their mean."""
    k = min(k, len(vectors))
    order = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    centres = vectors[order[[(2 * i + 1) * len(vectors) // (2 * k) for i in range(k)]]]
    for _ in range(10):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (vectors @ centres.T).argmax(axis=1)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for part in slices(batch, rows=ROWS):
            texts = part.column("text").to_pylist()
            total += (count_grams(texts) > 0).sum(axis=0)
            rows += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array([rows, *total], pa.int64())],
                                     names=["gram", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, rows=ROWS)):
        counts = count_grams(batch.column("text").to_pylist())
        places = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
             pa.array([c[p].astype("<f4").tobytes() for c, p in zip(counts, places)], pa.binary())],
            names=["lang", "places", "counts"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """A model from (doc_id, text, lang). Sums over all rows make one row per n-gram; the sample is bounded."""
    labelled = need(labelled, "doc_id", "text", "lang").filter("text is not null and lang is not null")
    sums = labelled.select("text").mapInArrow(_document_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = {r["gram"]: r["n"] for r in sums.collect()}
    rows = counted.pop(-1, 0)
    df = np.array([counted.get(g, 0) for g in range(DIMS)])
    idf = np.log((1 + rows) / (1 + df)) + 0.1
    keyed = labelled.withColumn("key", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("key")
    chosen = (keyed.select("lang", "key").withColumn("place", F.row_number().over(order))
              .filter(F.col("place") <= per_language).select("lang", "key"))
    # per_language rows a language: keys are ranked without their texts, which then are read once more
    picked = keyed.join(F.broadcast(chosen), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])
    sample: dict[str, list[np.ndarray]] = {}
    for row in picked.select("text", "lang").mapInArrow(_vectors, "lang string, places binary, counts binary").toLocalIterator():
        if row["lang"] not in sample and len(sample) >= MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        counts = np.zeros(DIMS, np.float32)
        counts[np.frombuffer(row["places"], "<u2")] = np.frombuffer(row["counts"], "<f4")
        if counts.any():
            sample.setdefault(row["lang"], []).append(counts)
    languages, centroids, nearest = [], [], []
    for lang in sorted(sample):
        vectors = unit(np.stack(sorted(sample[lang], key=lambda v: v.tobytes())), idf)
        centres, near = _kmeans(vectors, clusters)
        own = (vectors @ centres.T).max(axis=1)
        usual = np.quantile(own, 0.01)
        for c, centre in enumerate(centres):
            mine = min(usual, np.quantile(own[near == c], 0.01)) if (near == c).any() else usual
            languages.append(lang)
            centroids.append(centre)
            nearest.append(REJECT * float(mine))
    return Model(languages, np.stack(centroids) if centroids else np.zeros((0, DIMS)), np.array(nearest), idf)


def _identify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, rows=ROWS):
                lang, score, rejected = model.value.predict(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])
    return run


def _accept(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, rows=ROWS):
                rejected = model.value.predict(rows.column("text").to_pylist())[2]
                yield rows.filter(pa.array(~rejected, pa.bool_()))
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * CLUSTERS vectors
    return need(docs, "doc_id", "text").mapInArrow(_identify(shared),
                                                   "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accept(shared), docs.schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce(held_out(), F.lit(False)))


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
