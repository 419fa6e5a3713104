"""Words, n-grams and sets of whole Arrow batches with numpy: no Python loop over words.

Texts are taken as UTF-8 bytes. A word is a run of bytes outside 0x20 and 0x09-0x0D. Word and n-gram ids are 64-bit
hashes; what is compared as a set uses their upper 52 bits, so two sets of a thousand members differ by a chance
collision once in some 10^9 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240229)
VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 2**64)
SET_BITS = U(52)
SET_MASK = U(2**52 - 1)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 20), U(base))
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n <= 1 << 23:
            _powers[base] = p
    return p[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h ^ U(seed & (2**64 - 1))
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Block:
    """Some whole texts of a batch: rows `first` to `last`, their bytes and the bounds of each."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.rows = len(bounds) - 1

    def words(self, fold: bool) -> Words:
        return Words(self, fold)

    def spans(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of `solid` bytes; no run crosses a text's end."""
        cut = np.zeros(len(solid) + 1, bool)
        cut[self.bounds] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:-1]
        end[:-1] &= ~solid[1:] | cut[1:-1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, U)
        np.cumsum((FOLDED if fold else VALUES)[self.data] * _power(STEP, n), out=total[1:])
        return mix((total[end] - total[start]) * _power(BACK, n + 1)[start] + (end - start).astype(U))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


class Words:
    """Words of a block: `row`, byte `start` and `end`, `hash`, and per row the index of its `first` word and their number `n`."""

    def __init__(self, block: Block, fold: bool):
        self.block = block
        self.start, self.end = block.spans(~GAP[block.data])
        self.hash = block.hashes(self.start, self.end, fold)
        self.row = block.row_of(self.start)
        self.n = np.bincount(self.row, minlength=block.rows)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64) if block.rows else np.zeros(0, np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words inside one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.row[:m] == self.row[k - 1:])
        h = np.zeros(len(at), U)
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + self.hash[at + j]
        return at, mix(h)

    def sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and member of each row's set of k-word shingles, sorted; with fewer words the whole sequence is one member."""
        at, h = self.grams(k)
        row = self.row[at]
        short = np.flatnonzero((self.n > 0) & (self.n < k))
        if len(short):
            more = np.zeros(len(short), U)
            for j in range(k - 1):
                has = self.n[short] > j
                more[has] = more[has] * U(0xD6E8FEB86659FD93) + self.hash[self.first[short[has]] + j]
            row, h = np.concatenate([row, short]), np.concatenate([h, mix(more, 77)])
        both = np.unique((row.astype(U) << SET_BITS) | (h >> U(12)))
        return (both >> SET_BITS).astype(np.int64), both & SET_MASK


def blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[Block]:
    """A string column in blocks of whole texts of about `most` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + 4000, len(texts))
        yield Block(first, data[at[first]: at[last]], at[first: last + 1] - at[first])
        first = last


def per_row(row: np.ndarray, rows: int, values: np.ndarray) -> np.ndarray:
    """Sum of `values` by row, exact for uint64 with wrap-around; rows are sorted."""
    out = np.zeros(rows, values.dtype)
    if len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[begin]] = np.add.reduceat(values, begin)
    return out


class Lookup:
    """Position of 64-bit hashes in a sorted table, -1 where absent, by a directory of their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U(64 - max(8, int(len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.begin = np.searchsorted(keys, np.arange(size, dtype=U) << self.shift).astype(np.int64)
        self.begin = np.append(self.begin, len(keys))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        top = (h >> self.shift).astype(np.int64)
        at, stop, left = self.begin[top], self.begin[top + 1], np.arange(len(h))
        while len(left):
            live = at < stop
            left, at, stop = left[live], at[live], stop[live]
            hit = self.keys[at] == h[left]
            out[left[hit]] = at[hit]
            left, at, stop = left[~hit], at[~hit] + 1, stop[~hit]
        return out
