"""Elias-Fano sequences and a two-level n-gram trie over them, for vectorised queries.

A non-decreasing sequence of n values below u keeps the low log2(u/n) bits of each value
packed, and the high bits in unary: 2 + log2(u/n) bits a value. select() on the unary
bits finds a value, or where the values with given high bits start, from which
the successor of a value follows by a short binary search of low bits.
"""

from __future__ import annotations

import tempfile

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A bit vector with select of ones and zeros by a running count at every word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts  # counts[k]: ones before word k

    @staticmethod
    def of(ones: np.ndarray, size: int) -> Bits:
        words = np.zeros(size // 64 + 1, np.uint64)
        np.bitwise_or.at(words, ones >> 6, ONE << (ones & 63).astype(np.uint64))
        return Bits(words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """The place of the k-th one or zero, from 0."""
        counts = 64 * np.arange(len(self.counts)) - self.counts if zero else self.counts
        at = np.searchsorted(counts, k, side="right") - 1
        rest, x = k - counts[at], self.words[at]
        if zero:
            x = ~x
        place = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rest >= n
            rest = np.where(up, rest - n, rest)
            x = np.where(up, x >> np.uint64(half), x)
            place = place + half * up
        return place


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.low_bits, self.low_words, self.high = n, low_bits, low, high

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        """From non-decreasing uint64 values below 2**63."""
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = Bits.of(high + np.arange(n), n + (int(high[-1]) if n else 0) + 1)
        words = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            low = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(words, word, low << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return EliasFano(n, low_bits, words, unary)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low_words[word + 1] << (np.uint64(64) - np.maximum(shift, ONE)), np.uint64(0))
        return (self.low_words[word] >> shift | above) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high.select(i, False) - i).astype(np.uint64) << np.uint64(self.low_bits) | self.low(i)

    def start(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits."""
        zeros = len(self.high.words) * 64 - int(self.high.counts[-1])
        h = np.minimum(high, zeros)
        return np.where(h == 0, 0, np.minimum(self.high.select(np.maximum(h, 1) - 1, True) - (h - 1), self.n)) if self.n else np.zeros(len(high), np.int64)

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the least value >= x among places first to last - 1, or last."""
        end = np.full(len(x), self.n) if last is None else last
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        a, b = np.maximum(self.start(high), first), np.minimum(self.start(high + 1), end)
        a = np.minimum(a, end)
        todo = np.flatnonzero(a < b)
        while len(todo):
            middle = (a[todo] + b[todo]) >> 1
            less = self.low(middle) < low[todo]
            a[todo] = np.where(less, middle + 1, a[todo])
            b[todo] = np.where(less, b[todo], middle)
            todo = todo[a[todo] < b[todo]]
        return a

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits]), self.low_words, self.high.words, self.high.counts]

    @staticmethod
    def mapped(arrays: list[np.ndarray]) -> EliasFano:
        (n, low_bits), low, words, counts = arrays
        return EliasFano(int(n), int(low_bits), low, Bits(words, counts))


class Trie:
    """Contexts, and for each its successors with a quantised value, in memory-mapped levels.

    Level one holds the sorted contexts and monotone pointers to where the successors of
    each begin; level two holds successors relative to their context: the context's rank
    in the high bits, the successor's hash in the rest, which makes all lists one monotone
    sequence. A query finds the context's rank, follows its pointers, and
    searches the successor between them.
    """

    def __init__(self, contexts: np.ndarray, rank: np.ndarray, successors: np.ndarray, values: np.ndarray):
        """contexts sorted; rank, successors and values sorted by (rank, successor), successors below 2**63."""
        self.bits = 63 - max(1, len(contexts)).bit_length()
        pointers = np.searchsorted(rank, np.arange(len(contexts) + 1)).astype(np.uint64)
        relative = self.relative(rank, successors)
        levels = [EliasFano.of(contexts >> ONE), EliasFano.of(pointers), EliasFano.of(relative)]
        arrays = [a for level in levels for a in level.arrays()] + [values]
        self.file = tempfile.TemporaryFile()
        spans = []
        for a in arrays:
            at = self.file.tell()
            self.file.write(a.tobytes() or b"\0")
            self.file.write(b"\0" * (-self.file.tell() % 8))
            spans.append((at, a.dtype, len(a)))
        self.file.flush()
        self.bytes = self.file.tell()
        data = np.memmap(self.file, np.uint8, "r")
        back = [np.frombuffer(data, dtype, n, at) for at, dtype, n in spans]
        self.contexts, self.pointers, self.relatives = (EliasFano.mapped(back[4 * k : 4 * k + 4]) for k in range(3))
        self.values = back[-1]

    def relative(self, rank: np.ndarray, successors: np.ndarray) -> np.ndarray:
        return rank.astype(np.uint64) << np.uint64(self.bits) | successors >> np.uint64(63 - self.bits)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each context (-1: none), and the place of its successor's value (-1: none)."""
        x = contexts >> ONE
        rank = self.contexts.successor(x)
        inside = np.flatnonzero(rank < self.contexts.n)
        has = np.zeros(len(x), bool)
        has[inside] = self.contexts.get(rank[inside]) == x[inside]
        at, place = np.flatnonzero(has), np.full(len(x), -1)
        r = rank[at]
        want = self.relative(r, successors[at])
        first, last = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
        found = self.relatives.successor(want, first, last)
        inside = np.flatnonzero(found < last)
        hit = inside[self.relatives.get(found[inside]) == want[inside]]
        place[at[hit]] = found[hit]
        return np.where(has, rank, -1), place
