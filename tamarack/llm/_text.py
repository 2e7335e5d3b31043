"""Words of Arrow string columns as hashes, vectorised over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text worked on at once, which bounds the memory of the arrays over bytes.
PIECE = 1 << 21
#: Bytes up to which words are hashed in arrays, eight bytes a step.
_SHORT = 64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: their hashes and bytes' places, and of text i the words first[i] to first[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def other(self) -> Words:
        """The same words under hashes that are independent of ``hash``."""
        return Words(_hashes(self.data, self.start, self.end, 1), self.start, self.end, self.first, self.data)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, each with a space behind it, and where in that each begins (and the end of the last)."""
        begin = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        out = np.full(begin[-1], 0x20, np.uint8)
        size = self.end - self.start
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[:-1], size) + at] = self.data[np.repeat(self.start, size) + at]
        return out.tobytes(), begin


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, mixed after each step; of words beyond _SHORT bytes XXH3."""
    size, seed = end - start, _SEEDS[which]
    out = mixed(size.astype(np.uint64) * np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for at in range(0, _SHORT, 8):
        own = np.flatnonzero((size > at) & (size <= _SHORT))
        if not len(own):
            break
        left = np.minimum(size[own] - at, 8).astype(np.uint64)
        out[own] = mixed((out[own] ^ (eight[start[own] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8))))) + np.uint64(seed))
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes of text, or of one row."""
    offsets, _ = _buffers(column) if len(column) else (np.zeros(1, np.int64), None)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(column: pa.Array, lower: bool = False) -> Words:
    """All maximal runs of bytes other than 0x20 and 0x09-0x0D, a text's bounds counting as such; A-Z lower-cased if asked."""
    offsets, data = _buffers(column)
    base, data = offsets[0] if len(offsets) else 0, data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    offsets = offsets - base
    if lower:
        data = _LOWER[data]
    n = len(data)
    starts, ends = [], []
    at = 0
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # end behind a space or a text, however far
            tail = np.flatnonzero(_SPACE[data[to - 1 : min(n, to + PIECE)]])
            stop = int(offsets[np.searchsorted(offsets, to)])
            while not len(tail) and stop > to + PIECE:
                to += PIECE
                tail = np.flatnonzero(_SPACE[data[to - 1 : min(n, to + PIECE)]])
            to = min(stop, to + int(tail[0])) if len(tail) else stop
        b = data[at:to]
        w = ~_SPACE[b]
        cut = np.zeros(len(b) + 1, bool)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        cut[inner] = True
        cut[0] = cut[-1] = True
        before = np.empty(len(b), bool)
        before[0] = False
        before[1:] = w[:-1]
        s = np.flatnonzero(w & (~before | cut[:-1]))
        after = np.empty(len(b), bool)
        after[-1] = False
        after[:-1] = w[1:]
        e = np.flatnonzero(w & (~after | cut[1:])) + 1
        starts.append(s + at)
        ends.append(e + at)
        at = to
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start, end = cat(starts, np.int64), cat(ends, np.int64)
    return Words(_hashes(data, start, end), start, end, np.searchsorted(start, offsets), data)


def grams(w: Words, n: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and of text i the runs first[i] to first[i + 1].

    A text of 1 to n - 1 words has one run, of all its words, if ``short``.
    """
    count = np.diff(w.first)
    m = len(w.hash)
    k = np.maximum(count - n + 1, 0)
    full = np.zeros(max(m - n + 1, 0), np.uint64)
    for j in range(n if m >= n else 0):
        full = mixed(full + w.hash[j : m - n + 1 + j])  # mixed between steps, so that no two sequences agree by their form
    few = (count > 0) & (count < n) if short else np.zeros(len(count), bool)
    out_count = np.where(few, 1, k)
    first = np.concatenate([[0], np.cumsum(out_count)])
    out = np.empty(first[-1], np.uint64)
    if first[-1]:
        doc = np.repeat(np.arange(len(count)), out_count)
        place = w.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
        whole = ~few[doc]
        out[whole] = full[place[whole]]
        for i in np.flatnonzero(few):
            h = w.hash[w.first[i] : w.first[i + 1]]
            total = np.full(1, len(h), np.uint64)
            for x in h:
                total = mixed(total + x)
            out[first[i]] = total[0]
    return out, first


def sets(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-word hashes of each text."""
    hashes, first = grams(w, n)
    for i in range(len(first) - 1):
        x = np.sort(hashes[first[i] : first[i + 1]])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
