"""A compressed full-text index over sequences of integers: wavelet matrix over the Burrows-Wheeler transform, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text one is stored.
_SAMPLE = 8


class Bits:
    """A bit vector packed in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits in front of place i."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of symbols in a sequence, a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i stands after all levels, each taken as the symbol says."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and where the place stands after all levels."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; 0 ends a sequence, and of two suffixes that agree up to their ends the earlier is the smaller."""
    n = len(text)
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop) - 1, text + int(stop.sum())).astype(np.int64)
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search over sequences of positive integers, each ended by a 0 in ``text``."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        last = text[order - 1]  # of place 0 the 0 at the end
        self.n, sigma = len(text), int(text.max(initial=0)) + 1
        self.tree = Wavelet(last, max(1, sigma.bit_length()))
        every = np.arange(sigma)
        counts = np.bincount(text, minlength=sigma)
        self.shift = np.cumsum(counts) - counts - self.tree.down(every, np.zeros(sigma, np.int64))
        begins = np.concatenate([[True], text[:-1] == 0])  # never step back over an end
        kept = (order % _SAMPLE == 0) | begins[order]
        self.marked, self.places = Bits(kept), order[kept].astype(np.int32)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the symbol and then what [lo, hi) begins with."""
        ends = self.tree.down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        ends += np.concatenate([self.shift[symbol]] * 2)
        return ends[: len(lo)], ends[len(lo) :]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the index."""
        out, at, left, steps = np.empty(len(row), np.int64), np.arange(len(row)), row.astype(np.int64), 0
        while len(at):
            here = self.marked.get(left)
            out[at[here]] = self.places[self.marked.ones(left[here])] + steps
            at, left = at[~here], left[~here]
            symbol, left = self.tree.access(left)
            left, steps = left + self.shift[symbol], steps + 1
        return out

    def matching(self, ends: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of places of a text that is streamed against the index: how many symbols up to and with each, ``most`` of them at most, also occur elsewhere; and the interval of those that reach ``most``.

        Backward search; a place whose interval shrinks to one row, its own, or whose sequence begins, goes no further.
        """
        length = np.zeros(len(ends), np.int64)
        left, right = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for k in range(most):
            inside = ends[live] >= k
            inside[inside] = text[ends[live[inside]] - k] > 0
            live, lo, hi = live[inside], lo[inside], hi[inside]
            lo, hi = self.extend(text[ends[live] - k], lo, hi)
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            length[live] = k + 1
        left[live], right[live] = lo, hi
        return length, left, right

    def repeats(self, starts: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
        """For windows of ``length`` symbols of the text: the earliest place where each one's sequence begins, from those whose statistic reaches ``length``."""
        reach, lo, hi = self.matching(starts + length - 1, text, length)
        live = np.flatnonzero(reach == length)
        first = starts.copy()
        if len(live):
            at, back = np.unique(lo[live], return_inverse=True)
            size = np.zeros(len(at), np.int64)
            size[back] = (hi - lo)[live]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            rows = np.repeat(at - begin, size) + np.arange(size.sum())
            first[live] = np.minimum.reduceat(self.locate(rows), begin)[back]
        return first
