"""Operator 12: near-duplicates by the chosen-path set similarity join.

1. *Sketch.* A document is the set of its distinct shingles as 64-bit hashes; equal sets are one node. A node has ``T`` minwise
   tokens, the least of its shingles under ``T`` orders.
2. *Trees.* Each of ``TREES`` independent trees starts with all nodes. A tree node, named by its path, chooses tokens by a hash of
   that path and sends every document on to the child of its own token: two documents stay together with the probability of
   their similarity for each choice. Tree nodes of at most ``NODE`` rows and ``MEMBERS`` shingles are leaves; larger ones branch
   again. What is still too large after ``DEEPEST`` levels is dealt into blocks, each pair of which is a leaf: an exact end
   without any cap.
3. *Leaves* are compared exhaustively: all pairs of sketches in the task, of which only the clusters leave it, a row for each
   document that is like another. The bound is ``MARGIN`` standard deviations below the threshold.
4. *Confirmation.* Clusters that touch are joined to components. Full sets go once to each component, or to the clusters of a
   component that is too large; there all overlaps are counted, by products of the incidence of shared shingles, and the links
   leave as a forest. So no pair is ever written, and every link is confirmed on full sets.

Recall. A root has two children for each tree, a deeper tree node ``1 / s`` on average, the rate at which pairs below the threshold
``s`` grow fewer with each level. A pair at 0.85 is together in a child of the root with probability 0.85 and stays so on each
further level with 0.87: over the 16 children all but 1e-13 of such pairs meet in a leaf of the first level, all but 1e-9, 1e-7 and
2e-6 in leaves of the next three, and 0.98 in those of the eleventh. Sketches lose fewer than 1e-5. Links that other links imply
need not be found themselves.

Contract. Null and empty texts have empty sets, are linked with nothing and kept. Repeated rows are equal sets; rows that share the least
``doc_id`` of a component are all kept. A null ``doc_id`` takes part but names a component only if no other row does; it is kept
there only. An empty table gives no rows. Equal sets are told by a 64-bit name. Other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import discard, need, shared_folder, slices, staged
from courtside.llm.components import component_labels
from courtside.llm.hashing import STEP, mix
from courtside.llm.jaccard import _bitmap, _has, gram_set
from courtside.llm.overlaps import add_overlaps, groups, near_pairs, sorted_runs, united

T = 64                 # minwise tokens
TREES = 8
NODE = 1024            # rows of a leaf
MEMBERS = 1 << 22      # shingles of a leaf
DEEPEST = 10
MARGIN = 4.75
GROUP = 512            # rows of a component that is confirmed as a whole
WANTED_BITS = 24
_RANDOM = np.random.default_rng(12)
_TIMES = _RANDOM.integers(1, 2 ** 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 2 ** 64, T, dtype=np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The upper halves of the least hash under each order."""
    least = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 512):
        np.minimum(least, ((grams[start:start + 512, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def node_name(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def _sketched(n: int, percent: int):
    """A row for every document; the first of equal sets of a slice has the sketch, if a different set can be near enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                sets = [gram_set(t, n) for t in rows.column("text").to_pylist()]
                names = [node_name(s) if len(s) else None for s in sets]
                first = {name: s for name, s in zip(names, sets) if 100 * len(s) >= percent * (len(s) + 1)}
                sketches = [sketch(first.pop(name)).tobytes() if name in first else None for name in names]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(names, pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "node", "size", "sketch"])
    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, T)


def _branched(level: int, percent: int):
    """The children of each row: two tokens at the roots, further down one and another so often that ``100 / percent`` are chosen."""
    second = np.uint64(min(100 / percent - 1, 1) * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, node, size = _tokens(batch.column("sketch")), batch.column("node").to_numpy(), batch.column("size").to_numpy()
            rows = np.arange(len(node))
            if level == 1:
                paths = mix(np.repeat(np.arange(1, TREES + 1, dtype=np.uint64), len(rows)) * STEP)
                rows = np.tile(rows, TREES)
            else:
                paths = batch.column("path").to_numpy().view(np.uint64)
            for choice in range(2):
                hashed = mix(paths + np.uint64(choice + 1))
                some = np.ones(len(paths), bool) if choice == 0 or level == 1 else hashed >> np.uint64(32) < second
                which = (hashed[some] % np.uint64(T)).astype(np.int64)
                child = mix(hashed[some] * STEP + tokens[rows[some], which]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(node[rows[some]]), pa.array(size[rows[some]])],
                                                 names=["path", "node", "size"])
    return run


def _blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Tree nodes that no choice makes small, as all pairs of their blocks: each row goes once to each block."""
    several = F.ceil(F.greatest(2 * F.col("rows") / NODE, 2 * F.col("total") / MEMBERS, F.lit(2.0))).cast("int")
    dealt = members.join(large.select("path", several.alias("blocks")), "path").withColumn(
        "block", F.pmod(F.xxhash64("node", "path"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("path"), "node", "size")


def _alike(percent: int):
    """Leaves of trees: the rows that are like another of their leaf, with the least row of their cluster."""
    share = percent / 100
    least = T * share - MARGIN * (T * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves in sorted_runs(batches, "path"):
            paths, node, size = (leaves.column(c).to_numpy() for c in ("path", "node", "size"))
            tokens = _tokens(leaves.column("sketch")).astype(np.uint8)  # a byte of each is enough for leaves
            found_a, found_b = [], []
            for start, end in groups(paths):
                for at in range(start, end - 1):
                    after = slice(at + 1, end)
                    near = (tokens[after] == tokens[at]).sum(1) >= least
                    near &= (100 * np.minimum(size[after], size[at]) >= percent * np.maximum(size[after], size[at])) & (node[after] != node[at])
                    other = np.flatnonzero(near) + at + 1
                    if len(other):
                        found_a.append(np.full(len(other), at))
                        found_b.append(other)
            if not found_a:
                continue
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            label, some = united(len(node), a, b), np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(paths[some]), pa.array(node[some]), pa.array(node[label[some]])],
                                             names=["path", "node", "root"])
    return run


def _sets(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for rows in slices(batch):
                found = {}
                for text in rows.column("text").to_pylist():
                    s = gram_set(text, n)
                    name = node_name(s)
                    if len(s) and _has(bitmap, WANTED_BITS, np.array([name], np.int64).view(np.uint64))[0]:
                        found[name] = s.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())],
                                                 names=["node", "grams"])
    return run


def _linked(percent: int):
    """The links within each group of rows, on full sets, as a forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves in sorted_runs(batches, "key"):
            keys, node = leaves.column("key").to_numpy(), leaves.column("node").to_numpy()
            out_a, out_b = [], []
            for start, end in groups(keys):
                sets = [np.frombuffer(g, "<u8") for g in leaves.column("grams").slice(start, end - start).to_pylist()]
                label = united(len(sets), *_links(sets, percent))
                moved = np.flatnonzero(label != np.arange(len(sets)))
                out_a.append(node[start + label[moved]])
                out_b.append(node[start + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
    return run


def _links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets that are near enough."""
    total = np.zeros((len(sets), len(sets)), np.int32)
    add_overlaps(total, sets)
    return near_pairs(total, np.array([len(s) for s in sets], np.int64), percent)


def _by_key(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = need(docs, "doc_id", "text")
    rows = staged(texts.mapInArrow(_sketched(n, percent), "doc_id long, node long, size long, sketch binary"), "rows", folder)
    nodes = staged(rows.filter("sketch is not null").select("node", "size", "sketch").dropDuplicates(["node"]), "nodes", folder)

    members = nodes.mapInArrow(_branched(1, percent), "path long, node long, size long")
    clusters, level = None, 1
    while True:
        members = staged(members, f"members_{level}", folder)
        stats = staged(members.groupBy("path").agg(F.count("*").alias("rows"), F.sum("size").alias("total")).filter("rows > 1"),
                       f"stats_{level}", folder)
        fits = (F.col("rows") <= 2) | ((F.col("rows") <= NODE) & (F.col("total") <= MEMBERS)) | F.lit(level > DEEPEST)
        leaves = members.join(stats.filter(fits).select("path"), "path").join(nodes.select("node", "sketch"), "node")
        found = staged(_by_key(leaves, "path").mapInArrow(_alike(percent), "path long, node long, root long"), f"clusters_{level}", folder)
        clusters = found if clusters is None else clusters.unionByName(found)
        large = stats.filter(~fits)
        if large.isEmpty():
            break
        if level == DEEPEST:
            members = _blocks(members, large)
        else:
            more = members.join(large.select("path"), "path").join(nodes.select("node", "sketch"), "node")
            members = more.mapInArrow(_branched(level + 1, percent), "path long, node long, size long")
        level += 1

    near = component_labels(clusters.select(F.col("root").alias("a"), F.col("node").alias("b")), f"{folder}/near")
    sized = near.join(nodes.select("node", "size"), "node")
    whole = sized.groupBy("label").agg(F.count("*").alias("rows"), F.sum("size").alias("total"))
    whole = near.join(whole, "label").withColumn("whole", (F.col("rows") <= GROUP) & (F.col("total") <= MEMBERS))
    keys = staged(clusters.join(whole.select("node", "label", "whole"), "node").select(
        F.when(F.col("whole"), F.xxhash64("label")).otherwise(F.xxhash64("path", "root")).alias("key"), "node").distinct(), "keys", folder)
    wanted = spark.sparkContext.broadcast(_bitmap(near.select("node"), "node", WANTED_BITS))
    sets = texts.mapInArrow(_sets(n, wanted), "node long, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))
    links = _by_key(keys.join(sets, "node"), "key").mapInArrow(_linked(percent), "a long, b long")
    labels = component_labels(staged(links, "links", folder), f"{folder}/linked")

    named_by = (rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
              .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    named = named_by.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named_by.select("node", "label").join(named, "label").select("node", "component_id")
    result = staged(rows.select("doc_id", "node", F.col("size").alias("n_shingles")).join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    wanted.destroy()
    discard(spark, folder)
    return result


def query(docs: DataFrame) -> DataFrame:
    return near_groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, COUNT(*) AS o
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * o >= 85 * (n - o) UNION ALL SELECT y, x FROM p WHERE 100 * o >= 85 * (n - o)),
r AS (SELECT doc_id AS start, doc_id AS node FROM s UNION SELECT r.start, l.y FROM r JOIN l ON r.node = l.x),
c AS (SELECT start, MIN(node) AS component_id FROM r GROUP BY start)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.start = s.doc_id
"""
