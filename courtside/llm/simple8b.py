"""Simple-8b coding of unsigned integers in numpy, many blocks at once.

File format. A block is ``n_ids, n_words, n_raw`` (little-endian unsigned 32-bit), then ``n_words`` words and ``n_raw``
raw values (little-endian unsigned 64-bit). The upper four bits of a word are its selector ``s``: 1 to 14 say how many
values of how many bits follow from the lowest bit on (``COUNTS[s]``, ``WIDTHS[s]``), 0 is an escape whose lower bits
hold the place of one value of over 60 bits among the raw values. The last word is padded with zeros; ``n_ids`` ends it.
"""

from __future__ import annotations

import numpy as np

# Values in a word and bits of each, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
U8 = np.dtype("<u8")
HEADER = np.dtype("<u4")
PAD = 60


def _bits(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(values), np.uint8)
    for w in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        bits += values >= np.uint64(1 << w)
    return bits  # place of the narrowest width that holds the value, 14 if none does


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most values from there on."""
    rank = _bits(values)
    rank[values > 0] += 1  # zeros fit everywhere; place r - 1 of the widths is selector r
    spans, size = {1: rank}, 1
    while size * 2 <= PAD:
        last = spans[size]
        spans[size * 2] = np.maximum(last, np.concatenate([last[size:], np.zeros(size, np.uint8)]))
        size *= 2
    out = np.zeros(len(values), np.uint8)
    for s in range(14, 0, -1):
        n = int(COUNTS[s])
        half = 1 << (n.bit_length() - 1)
        top = spans[half]
        if n > half:
            top = np.maximum(top, np.concatenate([top[n - half:], np.zeros(n - half, np.uint8)]))
        out[top <= s] = s
    return out


def encode_blocks(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Blocks of ``values`` that end before the places in ``ends``; every block is coded on its own."""
    lengths = np.diff(ends, prepend=0)
    blocks = len(ends)
    if not blocks:
        return []
    shift = np.arange(blocks) * PAD
    padded = np.zeros(len(values) + blocks * PAD, np.uint64)
    padded[np.arange(len(values)) + np.repeat(shift, lengths)] = values
    begin, stop = ends - lengths + shift, ends + shift
    selector = _selectors(padded)
    at, live, steps = begin.copy(), np.flatnonzero(lengths), []
    while len(live):
        step = np.full(blocks, -1, np.int64)
        step[live] = at[live]
        steps.append(step)
        at[live] += COUNTS[selector[at[live]]]
        live = live[at[live] < stop[live]]
    if not steps:
        return [np.zeros(3, HEADER).tobytes()] * blocks
    heads = np.stack(steps, axis=1)
    words_of = (heads >= 0).sum(axis=1)
    heads = heads.ravel()
    heads = heads[heads >= 0]
    chosen = selector[heads]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            n, w = int(COUNTS[s]), int(WIDTHS[s])
            word = words[mine]
            for j in range(n):
                word |= padded[heads[mine] + j] << np.uint64(j * w)
            words[mine] = word
    escaped = np.flatnonzero(chosen == 0)
    first_word = np.cumsum(words_of) - words_of
    raw_of = np.zeros(blocks, np.int64)
    if len(escaped):
        owner = np.searchsorted(first_word, escaped, side="right") - 1
        # Empty blocks share their first word with the next block, which owns it.
        raw_of = np.bincount(owner, minlength=blocks)
        words[escaped] = (np.arange(len(escaped)) - (np.cumsum(raw_of) - raw_of)[owner]).astype(np.uint64)
    raw = padded[heads[escaped]]
    out, r = [], 0
    for b in range(blocks):
        w, m = int(words_of[b]), int(raw_of[b])
        head = np.array([lengths[b], w, m], HEADER).tobytes()
        start = int(first_word[b])
        out.append(head + words[start:start + w].astype(U8).tobytes() + raw[r:r + m].astype(U8).tobytes())
        r += m
    return out


def decode_blocks(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the blocks in a row, and how many each block holds."""
    heads = np.array([np.frombuffer(b, HEADER, 3) for b in blocks], np.int64).reshape(-1, 3)
    lengths, n_words, n_raw = heads.T
    words = [np.frombuffer(b, U8, int(w), 12) for b, w in zip(blocks, n_words)]
    raws = [np.frombuffer(b, U8, int(m), 12 + 8 * int(w)) for b, w, m in zip(blocks, n_words, n_raw)]
    words = np.concatenate(words) if words else np.zeros(0, U8)
    raw = np.concatenate(raws) if raws else np.zeros(0, U8)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    owner = np.repeat(np.arange(len(blocks)), n_words)
    counts = COUNTS[chosen]
    # The last word of a block may hold padding: it gives what its block still lacks.
    before = np.cumsum(counts) - counts
    per_block = np.bincount(owner, counts, minlength=len(blocks)).astype(np.int64)
    last = np.cumsum(n_words)[n_words > 0] - 1
    counts = counts.copy()
    counts[last] -= (per_block - lengths)[n_words > 0]
    before = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            n, w = int(COUNTS[s]), int(WIDTHS[s])
            mask = np.uint64((1 << w) - 1)
            word, place, room = words[mine], before[mine], counts[mine]
            for j in range(n):
                some = slice(None) if room.min() > j else room > j
                out[place[some] + j] = (word[some] >> np.uint64(j * w)) & mask
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        first_raw = np.cumsum(n_raw) - n_raw
        out[before[escaped]] = raw[first_raw[owner[escaped]] + words[escaped].astype(np.int64)]
    return out, lengths
