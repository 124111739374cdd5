"""Operator 1: benchmark decontamination by BM25 over an inverted index of the test items, with block-max pruning.

The test items are the collection. Every passage of every training text is a query and gets all items whose BM25 score
is at least ``share`` of what the item scores against itself. A passage is two neighbouring strides of words, a stride
being as long as the longest item and a quarter, so each copy of an item, also with words put in, lies in one passage whole.

*Block-max pruning.* Items are in blocks of ``BLOCK``; each term knows its highest share of score in each block. The
terms of many items only count by the most they could give in a block. Where the sum of the maxima of a
passage's terms stays below ``share``, no item of the block can reach it and none is scored. All others are scored
exactly; nothing is cut to a number of hits.

*Verification.* At least ``overlap`` of an item's distinct words and word pairs must be in the passage. One edit costs
a word and two pairs, so an item of 8 words or more keeps enough; the pairs ask for the order. Where the last line of an
item says that it is the answer, question and answer must each have their share.

Contract. Words are runs of letters and digits, in lower case. Null and empty texts have no passages; null, empty and
wordless items are never hit. Repeated documents are each reported; repeated items too, by their ids. An empty benchmark
leaves every text clean. Other columns stay as they are and are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, slices, staged

K1, B = 1.2, 0.75
BLOCK = 8
COMMON = 0.2          # terms in more than this share of the items only count by their bound
SLICE = 512 << 10    # bytes of text matched at once; the arrays of their passages and postings take many times as much
INDEX_BYTES = 32 << 20  # of item text in one index; more items make more indexes
GRAM = 2             # longest run of words that verification compares
ANSWER = re.compile(r"\s*(?:answer|a|antwort|respuesta|réponse|r)\s*[:：]", re.I)
_HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = text.lower()
    return text.encode().translate(_TABLE).split()


def grams(tokens: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    """All runs of up to ``n`` words."""
    return {tuple(tokens[i:i + k]) for k in range(1, min(n, len(tokens)) + 1) for i in range(len(tokens) - k + 1)}


class Collection(NamedTuple):
    """Statistics of all items, however many indexes they are dealt to."""

    items: int
    average: float
    longest: int
    in_items: dict[bytes, int]  # items that hold a word; the words of one index suffice there


def collection(tokens: list[list[bytes]]) -> Collection:
    return Collection(len(tokens), sum(map(len, tokens)) / max(1, len(tokens)), max(map(len, tokens), default=1),
                      Counter(w for t in tokens for w in set(t)))


class ItemIndex:
    """Inverted index of one set of items, small enough for every task. Scores and passages are those of ``whole``, the
    collection the items are part of."""

    def __init__(self, items: list[tuple[int, str]], share: float, overlap: float, whole: Collection | None = None):
        self.share, self.overlap = share, overlap
        rows = [(item, text, words(text)) for item, text in items]
        # Items of like length share a block, so that their maxima are close.
        rows = sorted((r for r in rows if r[2]), key=lambda r: (len(r[2]), r[2], r[0] is None, r[0]))
        self.items = [r[0] for r in rows]
        whole = whole or collection([r[2] for r in rows])
        self.stride = whole.longest + whole.longest // 4
        self.parts = []
        for _, text, tokens in rows:
            head, _, last = text.strip().rpartition("\n")
            sign = ANSWER.match(last)
            question, answer = (words(head), words(last[sign.end():])) if sign and words(head) else (tokens, [])
            # A question and an answer have each their own n-grams; all are short, as items are.
            self.parts.append((grams(question), grams(answer), len(question), len(answer)))
        in_items = whole.in_items
        self.terms = {w: t for t, w in enumerate(dict.fromkeys(w for _, _, tokens in rows for w in tokens))}
        self.weights: list[dict[int, float]] = []
        for _, _, tokens in rows:
            norm = K1 * (1 - B + B * len(tokens) / whole.average)
            score = {w: log(1 + (whole.items - in_items[w] + 0.5) / (in_items[w] + 0.5)) * n * (K1 + 1) / (n + norm)
                     for w, n in Counter(tokens).items()}
            self.weights.append({self.terms[w]: s / sum(score.values()) for w, s in score.items()})
        self.blocks = -(-len(rows) // BLOCK)
        common = {t for w, t in self.terms.items() if in_items[w] > COMMON * whole.items and in_items[w] > 2}
        best: dict[tuple[int, int], float] = {}
        self.common_bound = np.zeros(self.blocks)
        for i, weights in enumerate(self.weights):
            block = i // BLOCK
            shared = sum(s for t, s in weights.items() if t in common)
            self.common_bound[block] = max(self.common_bound[block], shared)
            for t, s in weights.items():
                if t not in common:
                    best[t, block] = max(best.get((t, block), 0.0), s)
        keys = sorted(best)
        self.posting_block = np.array([k[1] for k in keys], np.int64)
        self.posting_best = np.array([best[k] for k in keys])
        self.posting_start = np.searchsorted(np.array([k[0] for k in keys], np.int64), np.arange(len(self.terms) + 1))

    def candidates(self, terms: np.ndarray, segment: np.ndarray, last_segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose bound reaches the share. A passage has the number of its first segment;
        ``last_segment`` tells for each segment whether it ends its text."""
        present = np.unique(segment[terms >= 0] * len(self.terms) + terms[terms >= 0])
        where, term = np.divmod(present, max(1, len(self.terms)))
        lengths = self.posting_start[term + 1] - self.posting_start[term]
        at = np.arange(int(lengths.sum())) + np.repeat(self.posting_start[term] - (np.cumsum(lengths) - lengths), lengths)
        where, best = np.repeat(where, lengths), self.posting_best[at]
        key = where * self.blocks + self.posting_block[at]
        # A segment counts for its own passage and for the one before it in the same text.
        earlier = (where > 0) & ~last_segment[np.maximum(where - 1, 0)]
        key = np.concatenate([key, key[earlier] - self.blocks])
        best = np.concatenate([best, best[earlier]])
        passages, place = np.unique(key, return_inverse=True)
        bound = np.bincount(place, best, minlength=len(passages))
        passage, block = np.divmod(passages, max(1, self.blocks))
        enough = bound + self.common_bound[block] >= self.share - 1e-9
        passage, block = passage[enough], block[enough]
        free = np.flatnonzero(self.common_bound >= self.share - 1e-9)  # blocks that common terms alone can reach
        if len(free):
            all_of = np.arange(len(last_segment))
            both = np.unique(np.concatenate([passage * self.blocks + block,
                                             (all_of[:, None] * self.blocks + free[None, :]).ravel()]))
            passage, block = np.divmod(both, self.blocks)
        return passage, block

    def hits(self, texts: list[str | None]) -> list[dict[int, tuple]]:
        """For each text its items with (score, question overlap, answer overlap, first word) of the best passage."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.items:
            return found
        get = self.terms.get
        tokens = [words(t) for t in texts]
        counts = np.array([len(t) for t in tokens])
        ids = np.array([get(w, -1) for t in tokens for w in t], np.int64)
        segments = -(-counts // self.stride)
        first_segment = np.cumsum(segments) - segments
        first_word = np.cumsum(counts) - counts
        place = np.arange(len(ids)) - np.repeat(first_word, counts)
        segment = np.repeat(first_segment, counts) + place // self.stride
        last = np.zeros(int(segments.sum()), bool)
        last[(first_segment + segments - 1)[segments > 0]] = True
        owner = np.repeat(np.arange(len(texts)), segments)
        for passage, block in zip(*(x.tolist() for x in self.candidates(ids, segment, last))):
            doc = int(owner[passage])
            low = (passage - int(first_segment[doc])) * self.stride
            high = min(low + 2 * self.stride, int(counts[doc]))
            here = set(ids[first_word[doc] + low:first_word[doc] + high].tolist())
            own = None
            for i in range(block * BLOCK, min((block + 1) * BLOCK, len(self.items))):
                score = sum(s for t, s in self.weights[i].items() if t in here)
                if score < self.share - 1e-9 or (i in found[doc] and found[doc][i][0] >= score):
                    continue
                own = tokens[doc][low:high] if own is None else own
                question, answer, nq, na = self.parts[i]
                q = self._overlap(question, nq, own)
                a = self._overlap(answer, na, own) if na else 1.0
                if q >= self.overlap and a >= self.overlap:
                    found[doc][i] = (score, q, a, low)
        return found

    @staticmethod
    def _overlap(wanted: set, length: int, own: list[bytes]) -> float:
        return len(wanted & grams(own, min(GRAM, length))) / len(wanted)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of every item, and a row without word that has its length."""
    for batch in batches:
        for rows in slices(batch):
            parts, found, sizes = [], [], []
            for part, text in zip(rows.column("part").to_pylist(), rows.column("text").to_pylist()):
                tokens = words(text)
                if tokens:
                    own = sorted(set(tokens))
                    parts += [part] * (len(own) + 1)
                    found += [None, *own]
                    sizes += [len(tokens)] + [None] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())],
                                             names=["part", "word", "size"])


def _collections(items: DataFrame, number: int) -> list[Collection]:
    """The collection as each of several indexes sees it: with the words of its own items only."""
    found = staged(items.mapInArrow(_item_words, "part int, word binary, size long"), "words", shared_folder(items.sparkSession))
    count, total, longest = found.agg(F.count("size"), F.sum("size"), F.max("size")).first()
    held = found.filter("word is not null").groupBy("word", "part").count()
    everywhere = held.groupBy("word").agg(F.sum("count").alias("n"))
    held = staged(held.select("word", "part").join(everywhere, "word"), "held", shared_folder(items.sparkSession))
    return [Collection(count, (total or 0) / max(1, count), longest or 1,
                       {bytes(r["word"]): r["n"] for r in held.filter(F.col("part") == k).toLocalIterator()})
            for k in range(number)]


def item_indexes(items: DataFrame, share: float, overlap: float, index_bytes: int = INDEX_BYTES) -> Iterator:
    """Broadcast indexes, one after the other. Each holds about ``index_bytes`` of text at most, however many items there
    are; scores, passages and hits are the same for any number of them."""
    items = need(items, "item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = -(-size // index_bytes)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, number))).cast("int"))
    wholes = _collections(items, number) if number > 1 else [None] * number
    for k, whole in enumerate(wholes):
        own = items.filter(F.col("part") == k).select("item_id", "text").toLocalIterator()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in own], share, overlap, whole))


def _report(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _HITS.split(", ")]
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                docs = rows.column("doc_id").to_pylist()
                out = [(docs[d], index.value.items[i], *hit)
                       for d, found in enumerate(index.value.hits(rows.column("text").to_pylist()))
                       for i, hit in found.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], t) for c, t in enumerate(
                        [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()])], names=names)
    return run


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                found = index.value.hits(rows.column("text").to_pylist())
                yield rows.filter(pa.array([not f for f in found], pa.bool_()))
    return run


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.8,
                 index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and item of which it holds a copy, with the best passage's score and overlaps."""
    out = None
    for index in item_indexes(items, share, overlap, index_bytes):
        hits = need(docs, "doc_id", "text").mapInArrow(_report(index), _HITS)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], _HITS) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.8,
                  index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no copy of an item, all columns kept, without a shuffle. Between two indexes
    the rows are written, so that a task holds one index."""
    for number, index in enumerate(item_indexes(items, share, overlap, index_bytes)):
        if number:
            docs = staged(docs, "docs", shared_folder(docs.sparkSession))
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs
