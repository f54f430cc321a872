"""Elias-Fano sequences on numpy: a monotone sequence in about 2 + log2(universe / n) bits a value, searched in bulk."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words, with a spare word."""
    out = np.zeros(len(values) * width // 64 + 2, "<u8")
    if not width:
        return out
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    values = values.astype(np.uint64)
    for index, part in ((word, values << shift), (word + 1, np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0)))):
        # Positions are sorted: each word's parts are neighbours.
        if len(index):
            first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            out[index[first]] |= np.bitwise_or.reduceat(part, first)
    return out


def read_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    value = words[word] >> shift | np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
    return value & np.uint64((1 << width) - 1)


def select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number ``rank`` (from 0)."""
    word, rank = word.copy(), rank.astype(np.int64)
    place = np.zeros(len(word), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
        up = rank >= low
        rank -= np.where(up, low, 0)
        place += up * step
        word >>= (up * step).astype(np.uint64)
    return place


class EliasFano:
    """``arrays()`` are all its data; made from them again over a memory map."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values``: sorted, below ``universe``."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = pack_bits(values & np.uint64((1 << bits) - 1), bits)
        top = (max(1, universe) >> bits) + 1
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(n + top + 1) // 64) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        kind = "<u4" if len(flags) < 1 << 32 else "<u8"
        return cls(n, bits, low, high, ones.astype(kind), zeros.astype(kind))

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit positions of ones, or zeros, by rank."""
        before = self.zeros if zeros else self.ones
        # Of one type with what is searched, which else would be copied as a whole.
        word = np.searchsorted(before, rank.astype(before.dtype), "right") - 1
        bits = self.high[word]
        return word * 64 + select_in_word(~bits if zeros else bits, rank - before[word].astype(np.int64))

    def get(self, index: np.ndarray) -> np.ndarray:
        high = self._select(index, False) - index
        return (high.astype(np.uint64) << np.uint64(self.low_bits) | read_bits(self.low, index, self.low_bits)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it isn't there: the successor within its high part, compared."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        end = self._select(high, True) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        todo = np.flatnonzero(start < end)
        first, last, wanted = start[todo], end[todo], low[todo]
        # Lower bound by halving: a hot context may have most of its words in one high part.
        while len(open_ := np.flatnonzero(first < last)):
            middle = (first[open_] + last[open_]) >> 1
            less = read_bits(self.low, middle, self.low_bits) < wanted[open_]
            first[open_] = np.where(less, middle + 1, first[open_])
            last[open_] = np.where(less, last[open_], middle)
        inside = np.flatnonzero(first < end[todo])
        hit = inside[read_bits(self.low, first[inside], self.low_bits) == wanted[inside]]
        out[todo[hit]] = first[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.low_bits], "<i8"), "low": self.low, "high": self.high, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> EliasFano:
        n, bits = arrays["meta"].tolist()
        return cls(n, bits, arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"])
