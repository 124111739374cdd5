"""Overlaps of all sets of a small group, and what they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

COLUMNS = 4096  # shared members in one product


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted input, cut where the key changes: no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edge = int(np.searchsorted(keys, keys[-1]))     # where the last key begins
        if held and held[-1].column(key)[-1].as_py() != keys[0] or edge:
            yield pa.concat_batches([*held, batch.slice(0, edge)])
            held = []
        held.append(batch.slice(edge))
    if held:
        yield pa.concat_batches(held)


def groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First place and end of each run of equal keys."""
    edges = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1)), len(keys)).tolist()
    return zip(edges[:-1], edges[1:])


def united(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place linked with each."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def add_overlaps(total: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds the sizes of all intersections, by products of the incidence of members that several sets hold."""
    if len(sets) == 2:
        total[0, 1] += len(np.intersect1d(*sets, assume_unique=True))
        total[1, 0] = total[0, 1]
        return
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = held[column] > 1                          # a member of one set is in no overlap
    row, column = row[several], (np.cumsum(held > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        there = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        there[row[part], column[part] - start] = 1
        total += (there @ there.T).astype(np.int32)


def near_pairs(total: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose overlap is at least ``percent`` of their union, looked at in bands of rows."""
    found = []
    for start in range(0, len(sizes), 256):
        overlap = total[start:start + 256].astype(np.int64)
        near = 100 * overlap >= percent * (sizes[start:start + 256, None] + sizes - overlap)
        a, b = np.nonzero(near)
        after = b > a + start
        found.append((a[after] + start, b[after]))
    return tuple(np.concatenate(side) for side in zip(*found))
