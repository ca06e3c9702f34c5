"""Counting quotient filters over packed n-grams of word ids.

An n-gram of k ids of b bits is permuted invertibly within its k * b bits, so its bits are spread
evenly whatever the words. The permuted key is cut into part (its top bits: which filter), quotient
(which slot) and the full remainder; nothing is hashed away, so counts are exact and the n-grams
come back out of the filter. A filter stores its entries sorted: a bit per used quotient, a bit per
run end, the remainders in whole bytes, a counter of one byte with a list for larger ones. Sorted
filters of one part merge into one by adding the counts of equal keys.

Keys are lists of uint64 limbs, the most significant first, so any k and b up to 64 work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from rankspark.llm.common import mix64

_HEAD = "<HHHHQQQ"
_SWEEPS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stir(lanes: list[np.ndarray], j: int, sweep: int, bits: int) -> np.ndarray:
    """What lane j is mixed with: a function of all other lanes."""
    with np.errstate(over="ignore"):
        acc = np.full(len(lanes[0]), (2 * sweep + 1) * 1000 + j, np.uint64) * _ODD
        for i, lane in enumerate(lanes):
            if i != j:
                acc = mix64(acc + (lane + np.uint64(1)) * _ODD)
    if len(lanes) == 1:
        acc[:] = mix64(acc)
    return acc >> np.uint64(64 - bits)


def permute(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """An invertible scramble of k ids of ``bits`` bits: each lane in turn is xored with a function
    of the others."""
    lanes = [x.astype(np.uint64) for x in lanes]
    for sweep in range(_SWEEPS):
        for j in range(len(lanes)):
            lanes[j] = lanes[j] ^ _stir(lanes, j, sweep, bits)
    return lanes


def restore(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Undo ``permute``."""
    lanes = list(lanes)
    for sweep in reversed(range(_SWEEPS)):
        for j in reversed(range(len(lanes))):
            lanes[j] = lanes[j] ^ _stir(lanes, j, sweep, bits)
    return lanes


def pack(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """k lanes of ``bits`` bits as one number, in limbs of 64 bits."""
    k = len(lanes)
    limbs = [np.zeros(len(lanes[0]), np.uint64) for _ in range(-(-k * bits // 64))]
    for j, lane in enumerate(lanes):
        at, shift = divmod((k - 1 - j) * bits, 64)
        limbs[-1 - at] |= lane << np.uint64(shift)
        if shift + bits > 64:
            limbs[-2 - at] |= lane >> np.uint64(64 - shift)
    return limbs


def unpack(limbs: list[np.ndarray], k: int, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    lanes = []
    for j in range(k):
        at, shift = divmod((k - 1 - j) * bits, 64)
        lane = limbs[-1 - at] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (limbs[-2 - at] << np.uint64(64 - shift))
        lanes.append(lane & mask)
    return lanes


def summed(limbs: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and their added counts (``counts`` None: 1 each)."""
    n = len(limbs[0])
    if n == 0:
        return limbs, np.zeros(0, np.int64)
    if len(limbs) == 1 and counts is None:
        keys, total = np.unique(limbs[0], return_counts=True)
        return [keys], total.astype(np.int64)
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [x[order] for x in limbs]
    new = np.zeros(n, bool)
    new[0] = True
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first) if counts is not None else np.diff(np.append(first, n))
    return [x[first] for x in limbs], total.astype(np.int64)


class Counter:
    """Counts of the n-grams seen so far, of one k; new ones are summed up now and then."""

    def __init__(self, k: int, bits: int, pending: int = 1 << 20):
        self.k, self.bits, self.pending = k, bits, pending
        self.limbs, self.counts = [np.zeros(0, np.uint64) for _ in range(-(-k * bits // 64))], np.zeros(0, np.int64)
        self._more: list[tuple[list[np.ndarray], np.ndarray | None]] = []
        self._size = 0

    def add(self, lanes: list[np.ndarray]) -> None:
        """n-grams as they stand in the text, k columns of ids."""
        self.merge(pack(permute(lanes, self.bits), self.bits), None)

    def merge(self, limbs: list[np.ndarray], counts: np.ndarray | None) -> None:
        """Permuted, packed keys with their counts."""
        self._more.append(summed(limbs, counts))
        self._size += len(self._more[-1][1])
        if self._size >= max(self.pending, len(self.counts)):
            self.settle()

    def settle(self) -> None:
        if self._more:
            every = [(self.limbs, self.counts), *self._more]
            self._more, self._size = [], 0
            limbs = [np.concatenate([x[i] for x, _ in every]) for i in range(len(self.limbs))]
            self.limbs, self.counts = summed(limbs, np.concatenate([c for _, c in every]))

    def __len__(self) -> int:
        return len(self.counts) + self._size

    def filters(self, part_bits: int) -> Iterable[tuple[int, int, bytes]]:
        """part, entries, filter for every part that has entries."""
        self.settle()
        if not len(self.counts):
            return
        parts = _top(self.limbs, self.k * self.bits, part_bits)
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
            yield int(parts[a]), int(b - a), encode([x[a:b] for x in self.limbs], self.counts[a:b], self.k, self.bits, part_bits)

    def grams(self, least: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids (k columns) and counts of n-grams seen ``least`` times or more."""
        self.settle()
        often = self.counts >= least
        return restore(unpack([x[often] for x in self.limbs], self.k, self.bits), self.bits), self.counts[often]


def _top(limbs: list[np.ndarray], total: int, n: int) -> np.ndarray:
    """The top ``n`` (32 at most) of ``total`` bits."""
    at, shift = divmod(total - n, 64)
    if n == 0:
        return np.zeros(len(limbs[0]), np.uint64)
    out = limbs[-1 - at] >> np.uint64(shift)
    if shift + n > 64:
        out = out | (limbs[-2 - at] << np.uint64(64 - shift))
    return out & np.uint64((1 << n) - 1)


def encode(limbs: list[np.ndarray], counts: np.ndarray, k: int, bits: int, part_bits: int) -> bytes:
    """A filter of sorted distinct keys that share their top ``part_bits`` bits."""
    n, rest = len(counts), k * bits - part_bits
    # as many quotients as entries, about, and a remainder of whole bytes
    size = max(0, min(rest // 8, -(-(rest - n.bit_length()) // 8)))
    q = rest - 8 * size
    raw = np.stack(limbs, 1).astype(">u8").view(np.uint8).reshape(n, -1)
    wide = np.concatenate([np.zeros((n, 8), np.uint8), raw], 1)
    end = wide.shape[1] - size
    top = np.ascontiguousarray(wide[:, end - 8: end]).view(">u8").reshape(n).astype(np.uint64)
    quotient = top & np.uint64((1 << q) - 1)
    used = np.zeros(1 << q, bool)
    used[quotient.astype(np.int64)] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)
    large = counts > 254
    small = np.where(large, 255, counts).astype(np.uint8)
    part = int(top[0]) >> q if part_bits else 0
    return b"".join([
        struct.pack(_HEAD, k, bits, part_bits, size, n, part & ((1 << part_bits) - 1), int(large.sum())), np.packbits(used).tobytes(), np.packbits(run_end).tobytes(),
        np.ascontiguousarray(wide[:, end:]).tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()])


def decode(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted keys and counts of a filter."""
    k, bits, part_bits, size, n, part, large = struct.unpack_from(_HEAD, blob)
    q = k * bits - part_bits - 8 * size
    at = struct.calcsize(_HEAD)

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return np.frombuffer(blob, np.uint8, length, at - length)

    used = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
    run_end = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    remainder = take(n * size).reshape(n, size)
    counts = take(n).astype(np.int64)
    counts[counts == 255] = take(large * 8).view("<i8")
    run = np.cumsum(run_end) - run_end
    top = used[run].astype(np.uint64) | np.uint64(part << q)
    width = 8 * -(-k * bits // 64)
    wide = np.zeros((n, width + 8), np.uint8)
    end = wide.shape[1] - size
    wide[:, end - 8: end] = top.astype(">u8").view(np.uint8).reshape(n, 8)
    wide[:, end:] = remainder
    raw = np.ascontiguousarray(wide[:, 8:]).view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(raw[:, i]) for i in range(raw.shape[1])], counts
