"""Operator 3: exact n-gram Jaccard join and its groups, by vertical partitioning.

A document is the set of its distinct word n-grams as 64-bit hashes. Two documents link when
``100 * |A & B| >= percent * |A | B|``.

1. *Global order.* All n-grams are counted, by the upper 32 bits of their hash. Those of one document only come first, then
   those of several, last those that many hold; by hash in each. Linked documents share an n-gram within their
   prefixes, the first ``|A| - ceil(percent / 100 * |A|) + 1`` of the order. A document that has enough of its own is
   thereby in no pair at all, whatever passages it shares. For the smaller of two a shorter prefix is enough.
   Exact copies of a text are counted once, and only the first of them gives n-grams.
2. *Candidates.* Equal sets are one node. The nodes that hold a prefix n-gram in common are a bucket; each is paired
   with the smallest node of the bucket only, so a group of any size gives as many pairs as rows.
3. *Sketches.* A set's sketch is one or two bits per member, the parity of the members in each slot. Slots in which two sketches
   differ are never more than the members in which the sets do, so a pair whose sketches differ in too many has no link. Possible
   pairs join nodes; a bucket whose nodes still are apart is open. Buckets that touch are a cluster; its sketches meet once
   in a task, or, in a large cluster, once for each open bucket, cut into blocks where even that is too large. What is joined in
   the end is a family: linked nodes are in one, and only sets of families are looked at again.
4. *Vertical partitioning.* The range of the order is cut into fragments. The sets of the paired nodes are cut along,
   each fragment counts the overlaps of its own parts, and the counts are summed per pair.
5. *The rest.* Linked nodes get one component. The sets of a family that holds several meet in a task, a large family in blocks.
   There the overlaps of all of them are counted fragment by fragment and summed per pair, and the links leave as
   a forest. So no link between different components is lost, no pair is ever written, and there is no cap anywhere.

The counts travel as sorted runs of key differences, two bytes each, added up once per task and range of keys. What is alone,
what is common, which nodes are in a family and which text is the first of its copies comes back to the tasks as bitmaps and a
list of bounded size; there, a wrong guess costs time and never a result. Copies are told by a 64-bit hash of their text.

Contract. Null and empty texts have empty sets and are linked with nothing. Repeated rows are equal sets. A null
``doc_id`` takes part but names a group only if no other row does. An empty table gives no rows. Other columns of the
input are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import discard, need, shared_folder, slices, staged, width
from courtside.llm.components import component_labels
from courtside.llm.hashing import STEP, follow, mix, segment_hashes, segments
from courtside.llm.overlaps import add_overlaps, groups, near_pairs, sorted_runs, united

BITMAP_BITS = (27, 30)    # 16 MB, more with the texts; 128 MB at most
COPY_BITS = (24, 27)      # 2 MB, more with the documents; 16 MB at most
NODE_BITS = 24            # 2 MB
MOST_COMMON = 1 << 21     # entries of the common list at most
LEAST_COMMON = 16         # documents that hold a common n-gram, at least
RUN = 1 << 20             # n-grams a task adds up at once
FRAGMENTS = 8
CLUSTER = 4096            # nodes of open buckets whose sketches meet in one task
BLOCK = 4096              # nodes of one open bucket, or of a family, that do
MEMBERS = 1 << 22         # n-grams whose sets do
SKETCHED = 1 << 26        # n-grams whose sketches do
PRODUCT = 1 << 21         # words of sketches compared at once


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


_SPACE = _space()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: maximal runs of bytes other than white space, A-Z in lower case."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = ~_SPACE[raw]
    return segment_hashes(raw, inside, *segments(inside))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; of the whole sequence if it is shorter."""
    words = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    grams = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        grams = follow(grams, words[i:len(words) - n + 1 + i])
    return np.unique(grams)


def node_of(grams: np.ndarray) -> int:
    """Name of a set: a signed 64-bit hash of its members, -1 for the empty one."""
    if not len(grams):
        return -1
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1)))


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the members in each slot; slots are the least 64 * 2 ** k that are as many as the members."""
    slots = 64 << ((len(grams) - 1) // 64).bit_length()
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, count: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they are with fewer slots."""
    while words.shape[1] > count:
        words = words[:, :words.shape[1] // 2] ^ words[:, words.shape[1] // 2:]
    return words


def possible_pairs(sketches: list[bytes], size: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """The least place that pairs of different labels join with each, where their sketches allow a link."""
    joined = np.arange(len(size))
    by_length: dict[int, np.ndarray] = {}
    lengths = np.array([len(s) // 8 for s in sketches])
    for count in np.unique(lengths):
        place = np.flatnonzero(lengths == count)
        by_length[int(count)] = place[np.argsort(size[place], kind="stable")]
    words = {count: np.frombuffer(b"".join(sketches[i] for i in place), np.uint64).reshape(-1, count) for count, place in by_length.items()}
    for count, place in by_length.items():
        for other, partner in by_length.items():
            if other < count or size[partner[0]] > size[place[-1]] * 100 // percent:
                continue
            against = folded(words[other], count)
            start = 0
            while start < len(place):
                first = start + 1 if other == count else 0
                reach = int(np.searchsorted(size[partner], size[place[start]] * 100 // percent, "right")) - first
                end = start + max(1, min(PRODUCT // max(1, reach * count), len(place) - start))
                last = int(np.searchsorted(size[partner], size[place[end - 1]] * 100 // percent, "right"))
                step = max(1, PRODUCT // (count * (end - start)))
                for low in range(first, last, step):
                    some = slice(low, min(low + step, last))
                    differ = np.bitwise_count(words[count][start:end, None] ^ against[None, some]).sum(-1, dtype=np.int64)
                    near = (100 + percent) * differ <= (100 - percent) * (size[place[start:end], None] + size[partner[some]])
                    near &= label[place[start:end], None] != label[partner[some]]
                    a, b = np.nonzero(near)
                    if len(a):
                        kept = np.arange(len(size))
                        joined = united(len(size), np.concatenate([kept, place[start + a]]), np.concatenate([joined, partner[low + b]]))
                start = end
    return joined


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def index_length(size: int, percent: int) -> int:
    """The shorter prefix that is enough for the smaller one of two linked sets."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def _has(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _prefix(grams: np.ndarray, percent: int, common: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a set's prefix that another set may hold too, and which of them are in its shorter prefix."""
    rank = _has(shared, len(shared).bit_length() + 2, grams).astype(np.uint8)
    if len(common):
        keys = (grams >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        rank[common[at] == keys] = 2
    first = np.argsort(rank, kind="stable")[:prefix_length(len(grams), percent)]
    held = rank[first] > 0
    return grams[first[held]], np.flatnonzero(held) < index_length(len(grams), percent)


def _per_text(make, names: list[str]):
    """A task over (doc_id, text) batches: ``make`` gives the arrays of the output columns for one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_arrays(make(rows), names=names)
    return run


_NO_ID = np.iinfo(np.int64).min


def _copy_hashes(copy: pa.Array, doc_id: pa.Array) -> np.ndarray:
    """A hash of a text and a document."""
    doc = doc_id.cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(copy.to_numpy(zero_copy_only=False).view(np.uint64) * STEP + mix(doc))


def _first(rows: pa.RecordBatch, copies) -> np.ndarray:
    """Which rows may be the first of the copies of their text; the first one is never missed."""
    bitmap = np.frombuffer(copies.value, np.uint8)
    return _has(bitmap, len(bitmap).bit_length() + 2, _copy_hashes(rows.column("copy"), rows.column("doc_id")))


def _first_copies(texts: DataFrame) -> tuple[bytes, int]:
    """The bitmap of first copies, and the bytes of their texts."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID)))
    firsts = texts.groupBy("copy").agg(F.min(doc).alias("doc_id"), F.max(F.octet_length("text").cast("long")).alias("size"))
    documents, size = firsts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_copy_hashes(batch.column("copy"), batch.column("doc_id")).view(np.int64))], names=["hash"])

    hashes = firsts.select("copy", "doc_id").mapInArrow(hashed, "hash long")
    return _bitmap(hashes, "hash", _bits(documents << 5, COPY_BITS)), size


def _bits(slots: int, limits: tuple[int, int]) -> int:
    """Bits of a bitmap of about so many slots."""
    return min(max(slots.bit_length(), limits[0]), limits[1])


def _runs(n: int, ranges: int, copies):
    """Sorted runs of the keys of a task's n-grams: per range its first key, differences, and counts that exceed one."""
    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (keys.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)
        edges = np.append(np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 40))), len(keys))
        numbers, firsts, steps, many = [], [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            step, repeated = np.diff(keys[a:b]), np.flatnonzero(counts[a:b] > 1)
            numbers.append(int(part[a]))
            firsts.append(int(keys[a]))
            steps.append(step.astype("<u2" if step.max(initial=0) < 1 << 16 else "<u4").tobytes())
            many.append(np.stack([repeated, counts[a:b][repeated]]).astype("<u4").tobytes())
        sizes = np.diff(edges)
        return pa.RecordBatch.from_arrays([
            pa.array(numbers, pa.int32()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int32()),
            pa.array(steps, pa.binary()), pa.array(many, pa.binary())], names=["part", "first", "n", "steps", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch):
                for text in rows.column("text").filter(pa.array(_first(rows, copies))).to_pylist():
                    held.append((gram_set(text, n) >> np.uint64(32)).astype(np.uint32))
                    size += len(held[-1])
                    if size >= RUN:
                        yield added(held)
                        held, size = [], 0
        if size:
            yield added(held)
    return run


_RUNS = "part int, first long, n int, steps binary, many binary"
_COUNTS = "page long, bits binary, keys binary, counts binary, total long"


def _add_up(runs: pa.Table, bits: int) -> pa.Table:
    """All runs of one range: bitmap pages of the keys that several documents hold, and the counts of common ones."""
    keys, counts = [], []
    for first, n, steps, many in zip(*(runs.column(c).to_pylist() for c in ("first", "n", "steps", "many"))):
        step = np.frombuffer(steps, "<u2" if len(steps) == 2 * (n - 1) else "<u4")
        keys.append(first + np.concatenate([[0], np.cumsum(step, dtype=np.int64)]))
        one = np.ones(n, np.int64)
        place, number = np.frombuffer(many, "<u4").reshape(2, -1)
        one[place] = number
        counts.append(one)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    total = np.add.reduceat(counts, starts)
    held = total > 1
    keys, total = keys[starts][held], total[held]
    slots = np.unique(keys >> (32 - bits))
    pages, first = np.unique(slots >> 16, return_index=True)
    common = total >= LEAST_COMMON
    rows = [_page(part) for part in np.split(slots & 0xFFFF, first[1:])] if len(pages) else []
    rows.append(None)
    none = [None] * len(pages)
    return pa.table({
        "page": pa.array([*pages.tolist(), None], pa.int64()), "bits": pa.array(rows, pa.binary()),
        "keys": pa.array([*none, keys[common].astype("<u4").tobytes()], pa.binary()),
        "counts": pa.array([*none, np.minimum(total[common], (1 << 32) - 1).astype("<u4").tobytes()], pa.binary()),
        "total": pa.array([*none, int(total[common].sum())], pa.int64())})


def _page(slots: np.ndarray) -> bytes:
    page = np.zeros(1 << 16, np.uint8)
    page[slots] = 1
    return np.packbits(page, bitorder="little").tobytes()


def _common_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                out.append(np.frombuffer(keys, "<u4")[np.frombuffer(counts, "<u4") >= least].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["keys"])
    return run


def gram_counts(texts: DataFrame, n: int, copies, size: int, folder: str) -> tuple[bytes, bytes]:
    """The bitmap of n-grams that several different texts hold, and the sorted keys of the common ones. ``size`` is that of the texts."""
    spark, bits = texts.sparkSession, _bits(size >> 3, BITMAP_BITS)
    runs = texts.mapInArrow(_runs(n, 4 * width(spark), copies), _RUNS)
    counts = staged(runs.groupBy("part").applyInArrow(lambda t: _add_up(t, bits), _COUNTS), "counts", folder)
    bitmap = _collected(counts.filter("page is not null").select("page", "bits"), bits)
    total = counts.agg(F.sum("total")).first()[0] or 0
    least = max(LEAST_COMMON, -(-total // MOST_COMMON))  # so many rows hold no more n-grams than the list may have
    found = counts.filter("total > 0").select("keys", "counts").mapInArrow(_common_keys(least), "keys binary")
    keys = [np.frombuffer(r["keys"], "<u4") for r in found.collect()]
    return bitmap, np.sort(np.concatenate([np.zeros(0, "<u4"), *keys])).tobytes()


def _entries(n: int, percent: int, common, shared, copies):
    """A row without n-gram for every document, and the prefix entries of every different set of a slice, for first copies; the
    row of a set with entries has its sketch."""
    def make(rows):
        late, bitmap = np.frombuffer(common.value, "<u4"), np.frombuffer(shared.value, np.uint8)
        sets = [gram_set(t, n) for t in rows.column("text").to_pylist()]
        named = {node_of(sets[i]): sets[i] for i in np.flatnonzero(_first(rows, copies))}
        prefixes = {node: _prefix(s, percent, late, bitmap) for node, s in named.items() if node >= 0}
        own = [node_of(s) for s in sets]
        drawn = {node: sketch(named[node]) for node, (p, _) in prefixes.items() if len(p)}
        lengths = [len(p) for p, _ in prefixes.values()]
        more = sum(lengths)
        grams = np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in prefixes.values())]).view(np.int64)
        indexed = np.concatenate([np.zeros(len(sets), bool), *(i for _, i in prefixes.values())])
        nodes = np.concatenate([np.array(own, np.int64), np.repeat(np.array(list(prefixes), np.int64), lengths)])
        sizes = np.concatenate([np.array([len(s) for s in sets], np.int64),
                                np.repeat(np.array([len(named[k]) for k in prefixes], np.int64), lengths)])
        return [pa.concat_arrays([rows.column("doc_id").cast(pa.int64()), pa.nulls(more, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(grams, pa.int64())]),
                pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(indexed, pa.bool_()),
                pa.array([*(drawn.pop(node, None) for node in own), *[None] * more], pa.binary())]
    return _per_text(make, ["doc_id", "gram", "node", "size", "indexed", "sketch"])


def _fragments(n: int, wanted, copies):
    def make(rows):
        bitmap, nodes, numbers, parts, seen = np.frombuffer(wanted.value, np.uint8), [], [], [], set()
        for text in rows.column("text").filter(pa.array(_first(rows, copies))).to_pylist():
            s = gram_set(text, n)
            node = node_of(s)
            if node < 0 or node in seen or not _has(bitmap, NODE_BITS, np.array([node << 1], np.uint64))[0]:
                continue
            seen.add(node)
            cuts = np.searchsorted(s, np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64))
            for f, part in enumerate(np.split(s.view(np.int64), cuts)):
                nodes.append(node)
                numbers.append(f)
                parts.append(part)
        return [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
    return _per_text(make, ["node", "fragment", "grams"])


def _collected(pages: DataFrame, bits: int) -> bytes:
    """A bitmap from its pages of 8 KB: ``2 ** (bits - 16)`` of them, a few more where ranges share one."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pages.collect():
        out[row["page"] * 8192:(row["page"] + 1) * 8192] |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """Bits of the upper ``bits`` bits of a signed column."""
    slot = F.shiftrightunsigned(column, 64 - bits)

    def fold(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            slots = np.unique(piece.column("slot").to_numpy())
            at, first = np.unique(slots >> 16, return_index=True)
            rows = [_page(part) for part in np.split(slots & 0xFFFF, first[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.binary())], names=["page", "bits"])

    slots = hashes.select(slot.alias("slot")).distinct()
    slots = slots.repartitionByRange(16, "slot").sortWithinPartitions("slot")
    return _collected(slots.mapInArrow(fold, "page long, bits binary"), bits)


def _verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The linked ones among ``pairs`` (a, b, size_a, size_b), counted fragment by fragment."""
    left = pairs.join(parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a")), "a")
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = left.join(right, ["b", "fragment"]).select(
        "a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap"))
    union = F.col("size_a") + F.col("size_b") - F.col("overlap")
    return total.filter(100 * F.col("overlap") >= percent * union).select("a", "b")


def _counted_links(percent: int):
    """The links within each key, as a forest: overlaps are counted fragment by fragment and summed per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "key"):
            node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
            out_a, out_b = [], []
            for start, end in groups(rows.column("key").to_numpy()):
                fragments = rows.column("fragments").slice(start, end - start)
                inner = fragments.flatten()
                grams, ends = inner.flatten().to_numpy(), np.cumsum(np.append(0, inner.value_lengths().to_numpy()))
                total = np.zeros((end - start, end - start), np.int32)
                for f in range(FRAGMENTS):
                    add_overlaps(total, [grams[ends[i]:ends[i + 1]] for i in range(f, len(inner), FRAGMENTS)])
                label = united(end - start, *near_pairs(total, size[start:end], percent))
                moved = np.flatnonzero(label != np.arange(end - start))
                out_a.append(node[start + label[moved]])
                out_b.append(node[start + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
    return run


def _possible(percent: int):
    """The pairs (a, b) among rows (a, b, size_a, size_b, sketch_a, sketch_b) whose sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            differ = np.zeros(rows.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(rows.column("sketch_a").to_pylist(), rows.column("sketch_b").to_pylist())):
                a, b = np.frombuffer(a, np.uint64)[None], np.frombuffer(b, np.uint64)[None]
                count = min(a.shape[1], b.shape[1])
                differ[i] = np.bitwise_count(folded(a, count) ^ folded(b, count)).sum(dtype=np.int64)
            size = rows.column("size_a").to_numpy() + rows.column("size_b").to_numpy()
            yield rows.select(["a", "b", "size_a", "size_b"]).filter(pa.array((100 + percent) * differ <= (100 - percent) * size))
    return run


def _possible_links(percent: int):
    """What possible links between different labels join within each key, as a forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "key"):
            node, size, label = (rows.column(c).to_numpy() for c in ("node", "size", "label"))
            out_a, out_b = [], []
            for start, end in groups(rows.column("key").to_numpy()):
                joined = possible_pairs(rows.column("sketch").slice(start, end - start).to_pylist(), size[start:end], label[start:end], percent)
                moved = np.flatnonzero(joined != np.arange(end - start))
                out_a.append(node[start + joined[moved]])
                out_b.append(node[start + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
    return run


def _in_blocks(keys: DataFrame, members: int, *columns: str) -> DataFrame:
    """Rows (key, node, size, ...) under a key for each two blocks of theirs; small keys are one block."""
    stats = keys.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("total"))
    fits = (F.col("rows") <= 2) | (F.col("rows") <= BLOCK) & (F.col("total") <= members)
    several = F.when(fits, 1).otherwise(F.ceil(F.greatest(2 * F.col("rows") / BLOCK, 2 * F.col("total") / members, F.lit(2.0))))
    dealt = keys.join(stats.select("key", several.cast("int").alias("blocks")), "key").withColumn(
        "block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "size", *columns)


def _open_families(members: DataFrame, sketches: DataFrame, percent: int, folder: str) -> DataFrame:
    """Possible links (a, b) of the rows of open buckets (gram, first, node, size, label); each sketch meets those of its
    cluster or of its buckets."""
    clusters = component_labels(members.select(F.col("first").alias("a"), F.col("node").alias("b")), f"{folder}/clusters").select(
        "node", F.col("label").alias("cluster"))
    sizes = members.select("node", "size").distinct()
    many = clusters.join(sizes, "node").groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("size").alias("total"))
    whole = clusters.join(many.filter((F.col("rows") <= CLUSTER) & (F.col("total") <= SKETCHED)).select("cluster"), "cluster")
    keys = members.join(whole.select("node", "cluster"), "node", "left").select(
        F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster", F.lit(0))).otherwise(F.xxhash64("gram", F.lit(1))).alias("key"), "node", "size", "label")
    keys = staged(keys.distinct(), "open_keys", folder)
    met = _in_blocks(keys, SKETCHED, "label").join(sketches, "node").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_possible_links(percent), "a long, b long")


def _family_links(families: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets of each family (key, node, size)."""
    sets = (parts.join(families.select("node"), "node", "left_semi").groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("fragment", "grams"))).alias("fragments"))
            .select("node", F.transform("fragments", lambda x: x["grams"]).alias("fragments")))
    met = _in_blocks(families, MEMBERS).join(sets, "node").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_counted_links(percent), "a long, b long")


def _near(percent: int):
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return 100 * small >= percent * large


def jaccard_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, node, component_id): the smallest doc_id reachable by links from each document."""
    spark: SparkSession = docs.sparkSession
    context, folder = spark.sparkContext, shared_folder(spark)
    texts = need(docs, "doc_id", "text").withColumn("copy", F.xxhash64("text"))

    copied, size = _first_copies(texts)
    copies = context.broadcast(copied)
    bitmap, common = (context.broadcast(b) for b in gram_counts(texts, n, copies, size, folder))
    rows = staged(texts.mapInArrow(_entries(n, percent, common, bitmap, copies),
                                   "doc_id long, gram long, node long, size long, indexed boolean, sketch binary"), "entries", folder)
    entries = rows.filter("gram is not null").select("gram", "node", "size", "indexed")
    nodes = rows.filter("gram is null").select("doc_id", F.col("size").alias("n_shingles"), "node")
    sketches = rows.filter("sketch is not null").select("node", "sketch").dropDuplicates(["node"])
    smallest = (entries.groupBy("gram").agg(F.min(F.struct("node", "size")).alias("least"), F.max("node").alias("most"), F.bool_or("indexed").alias("indexed"))
                .filter("least.node < most and indexed").select("gram", F.col("least.node").alias("a"), F.col("least.size").alias("size_a")))
    buckets = staged(entries.join(smallest, "gram").select("gram", "a", "size_a", F.col("node").alias("b"),
                                                          F.col("size").alias("size_b"), "indexed"), "buckets", folder)
    stars = buckets.filter("a <> b").filter(_near(percent)).select("a", "b", "size_a", "size_b").distinct()
    stars = (stars.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
             .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b"))
    stars = staged(stars.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
                   .mapInArrow(_possible(percent), "a long, b long, size_a long, size_b long"), "stars", folder)
    labels = component_labels(stars, f"{folder}/near")

    # Buckets whose nodes are not all joined by now.
    member = (buckets.select("gram", F.col("b").alias("node"), F.col("size_b").alias("size")).distinct()
              .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = member.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first")).filter("low < high")
    open_ones = staged(member.join(mixed.select("gram", "first"), "gram").select("gram", "first", "node", "size", "label"), "open", folder)
    possible = staged(stars.select("a", "b").unionByName(_open_families(open_ones, sketches, percent, folder)), "possible", folder)
    families = component_labels(possible, f"{folder}/families").select("node", F.col("label").alias("family"))

    wanted = context.broadcast(_bitmap(families.select(F.shiftleft("node", 1).alias("node")), "node", NODE_BITS))
    parts = texts.mapInArrow(_fragments(n, wanted, copies), "node long, fragment int, grams array<long>")
    parts = staged(parts.dropDuplicates(["node", "fragment"]), "parts", folder)
    links = staged(_verified(stars, parts, percent), "links", folder)
    labels = component_labels(links, f"{folder}/first")

    # Families that are more than one component by now.
    sizes = nodes.select("node", F.col("n_shingles").alias("size")).distinct()
    member = families.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = member.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    open_ones = staged(member.join(mixed.select("family"), "family").join(sizes, "node").select(F.col("family").alias("key"), "node", "size"),
                       "open_families", folder)
    more = _family_links(open_ones, parts, percent)
    labels = component_labels(staged(links.unionByName(more), "all_links", folder), f"{folder}/second")

    named_by = (nodes.filter("node >= 0").groupBy("node").agg(F.min("doc_id").alias("least"))
              .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    named = named_by.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named_by.select("node", "label").join(named, "label").select("node", "component_id")
    result = staged(nodes.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", "node",
        F.when(F.col("node") < 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    for shared in (bitmap, common, wanted, copies):
        shared.destroy()
    discard(spark, folder)
    return result


def query(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of every group: the one with the smallest ``doc_id``, once if the row is repeated. Documents without
    words or without an id all stay; where that ``doc_id`` is repeated with different texts, one row of each text stays."""
    groups = jaccard_groups(docs, n, percent)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, COUNT(*) AS o
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * o >= 85 * (n - o) UNION ALL SELECT y, x FROM p WHERE 100 * o >= 85 * (n - o)),
r AS (SELECT doc_id AS start, doc_id AS node FROM s UNION SELECT r.start, l.y FROM r JOIN l ON r.node = l.x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT MIN(node) FROM r WHERE r.start = s.doc_id) AS component_id FROM s
"""
