"""A compressed FM-index over word sequences, vectorised over many queries.

The text of a shard is the concatenation of its segments, a separator (symbol 0) after each.
Suffixes are ordered by their first DEPTH symbols, which is all a window search needs. The
Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with block counts.
"""

from __future__ import annotations

import numpy as np


class PackedBits:
    """A bit vector in 64-bit words with a running count per word; rank for arrays."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a position, for arrays of both."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, PackedBits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.origin = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(position)
            position = np.where((symbol >> shift) & 1, zeros + ones, position - ones)
        return position

    def occurrences(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self._walk(symbol, position) - self.origin[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes, ordered by at least their first ``depth`` symbols."""
    n, rank, width = len(text), text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[: n - width] += rank[width:] + 1
        if width >= n:
            key = rank
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= depth:
            return order
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)


class FMIndex:
    """Index of a text of symbols 0..alphabet-1, searchable to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        self.order = suffix_order(text, depth)
        self.first = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet), out=self.first[1:])
        self.bwt = WaveletMatrix(text[self.order - 1], alphabet)
        self.text, self.depth = text, depth

    def matching_statistics(self, starts: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """For windows text[s : s + depth], the suffix interval by backward search. A window
        whose interval shrinks to itself before the last step is given an empty interval."""
        lo_all, hi_all = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for at in range(0, len(starts), block):
            live = np.arange(at, min(at + block, len(starts)))
            symbol = self.text[starts[live] + self.depth - 1]
            lo, hi = self.first[symbol], self.first[symbol + 1]
            for step in range(self.depth - 2, -1, -1):
                wide = hi - lo > 1
                live, lo, hi = live[wide], lo[wide], hi[wide]
                if not len(live):
                    break
                symbol = self.text[starts[live] + step]
                both = self.bwt.occurrences(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
                lo, hi = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live):]
            lo_all[live], hi_all[live] = lo, hi
        return lo_all, hi_all

    def interval_minimum(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest ``value`` of the text positions in each non-empty interval. Intervals of
        one depth are equal or disjoint, so each distinct one is reduced once."""
        begin, inverse = np.unique(lo, return_inverse=True)
        end = np.zeros(len(begin), np.int64)
        end[inverse] = hi
        in_order = np.append(value[self.order], np.iinfo(np.int64).max)
        edges = np.column_stack([begin, end]).ravel()
        return np.minimum.reduceat(in_order, edges)[::2][inverse] if len(begin) else np.zeros(0, np.int64)
