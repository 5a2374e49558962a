"""Elias-Fano encoding of sorted integer sets, with vectorized successor search (numpy)."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """values of ``bits`` bits each, packed one after another into 64-bit words."""
    words = np.zeros((len(values) * bits + 63) // 64 + 1, dtype=_U)
    if bits == 0 or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    np.bitwise_or.at(words, word, values << shift)
    over = (at & 63) + bits > 64
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(len(index), dtype=_U)
    at = index.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    out = words[word] >> shift
    over = (at & 63) + bits > 64
    out[over] |= words[word[over] + 1] << (_U(64) - shift[over])
    return out & _U((1 << bits) - 1)


class EliasFano:
    """A sorted set of distinct integers below 2**universe_bits.

    High bits stand in unary (a one for each value, a zero ending each bucket), low bits are packed: about
    2 + log2(universe / n) bits a value, and another 2 to 3 for the counts of zeros before each 64-bit word that
    serve the select (not stored, made anew by ``from_words``).
    """

    def __init__(self, values: np.ndarray, universe_bits: int):
        n = len(values)
        self.n, self.universe_bits = n, universe_bits
        self.low_bits = max(0, universe_bits - max(1, int(n).bit_length()))
        values = values.astype(_U)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        self.buckets = 1 << (universe_bits - self.low_bits)
        self.low = _pack(values & _U((1 << self.low_bits) - 1), self.low_bits)
        ones = high + np.arange(n, dtype=np.int64)
        self.high = np.zeros((n + self.buckets + 63) // 64, dtype=_U)
        np.bitwise_or.at(self.high, ones >> 6, _U(1) << (ones & 63).astype(_U))
        self._count_zeros()

    @classmethod
    def from_words(cls, n: int, universe_bits: int, low: bytes, high: bytes) -> EliasFano:
        """The set whose packed words were stored."""
        out = cls(np.zeros(0, dtype=_U), universe_bits)
        out.n, out.low_bits = n, max(0, universe_bits - max(1, int(n).bit_length()))
        out.buckets = 1 << (universe_bits - out.low_bits)
        out.low, out.high = np.frombuffer(low, dtype=_U), np.frombuffer(high, dtype=_U)
        out._count_zeros()
        return out

    def _count_zeros(self) -> None:
        zeros = 64 - np.bitwise_count(self.high).astype(np.int64)
        self.zeros_before = np.concatenate([[0], np.cumsum(zeros)]).astype(np.int64)

    @property
    def bits(self) -> int:
        """Size of the encoded set, directory included."""
        return 64 * (len(self.high) + len(self.zeros_before)) + self.low_bits * self.n

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the unary part."""
        word = np.searchsorted(self.zeros_before, k, side="right") - 1
        need = k - self.zeros_before[word] + 1
        inv, pos = ~self.high[word], np.zeros(len(k), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(inv & _U((1 << step) - 1)).astype(np.int64)
            right = below < need
            need = np.where(right, need - below, need)
            pos += np.where(right, step, 0)
            inv = np.where(right, inv >> _U(step), inv)
        return (word << 6) + pos

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the first value not below each probe, and whether it equals the probe."""
        probes = probes.astype(_U)
        if not self.n:
            return np.zeros(len(probes), dtype=np.int64), np.zeros(len(probes), dtype=bool)
        bucket = (probes >> _U(self.low_bits)).astype(np.int64)
        low = probes & _U((1 << self.low_bits) - 1)
        start = np.where(bucket > 0, self._select_zero(np.maximum(bucket - 1, 0)) + 1 - bucket, 0)
        end = self._select_zero(bucket) - bucket
        rank, found = start.copy(), np.zeros(len(probes), dtype=bool)
        live = np.flatnonzero(start < end)
        while len(live):
            here = _unpack(self.low, rank[live], self.low_bits)
            found[live] = here == low[live]
            ahead = here < low[live]
            live = live[ahead]
            rank[live] += 1
            live = live[rank[live] < end[live]]
        return rank, found

    def __contains__(self, value: int) -> bool:
        return bool(self.successor(np.array([value], dtype=_U))[1][0])

    def decode(self) -> np.ndarray:
        """All values, sorted."""
        if not self.n:
            return np.zeros(0, dtype=_U)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        high = (ones - np.arange(self.n)).astype(_U)
        return (high << _U(self.low_bits)) | _unpack(self.low, np.arange(self.n), self.low_bits)


class SeenSet:
    """A growing set: each batch is merged in, runs of like size fold together, so merging stays n log n."""

    def __init__(self, universe_bits: int):
        self.universe_bits, self.runs = universe_bits, []

    def seen(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=bool)
        for run in self.runs:
            rest = np.flatnonzero(~out)
            out[rest] = run.successor(values[rest])[1]
        return out

    def add(self, sorted_new: np.ndarray) -> None:
        """sorted_new: sorted, distinct, none of them in the set."""
        if not len(sorted_new):
            return
        while self.runs and self.runs[-1].n <= 2 * len(sorted_new):
            sorted_new = np.sort(np.concatenate([self.runs.pop().decode(), sorted_new]), kind="stable")
        self.runs.append(EliasFano(sorted_new, self.universe_bits))

    def values(self) -> np.ndarray:
        """All values, sorted."""
        return np.sort(np.concatenate([np.zeros(0, dtype=_U), *(r.decode() for r in self.runs)]), kind="stable")

    @property
    def bits(self) -> int:
        return sum(r.bits for r in self.runs)

    @property
    def n(self) -> int:
        return sum(r.n for r in self.runs)
