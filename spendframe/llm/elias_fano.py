"""Elias-Fano coding of rising numbers: about 2 + log2(range / count) bits each, with select.

Number i is cut into ``low_bits`` low bits, stored in place, and the rest, stored in unary: bit
(rest + i) of a bit array is set.  ``select`` finds the i-th set bit from a directory with one entry
for ``SAMPLE`` set bits, so any number is read without decoding those before it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 256
HEADER = struct.Struct("<QqBQQ")  # count, base, low bits, bytes of low and of high


@dataclass
class EliasFano:
    count: int
    base: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    directory: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: int64, never falling."""
        count = len(values)
        base = int(values[0]) if count else 0
        rest = (values.astype(np.int64) - base).astype(np.uint64)
        width = int(rest[-1]) // count if count else 0
        low_bits = max(0, width.bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(places[-1]) + 1 if count else 0, np.uint8)
        bits[places] = 1
        return cls(count, base, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = HEADER.pack(self.count, self.base, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, blob: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``blob``, and how many bytes it takes."""
        count, base, low_bits, n_low, n_high = HEADER.unpack_from(blob)
        at = HEADER.size
        low = np.frombuffer(blob, np.uint8, n_low, at)
        high = np.frombuffer(blob, np.uint8, n_high, at + n_low)
        n_directory = -(-count // SAMPLE)
        directory = np.frombuffer(blob, "<u4", n_directory, at + n_low + n_high)
        return cls(count, base, low_bits, low, high, directory), at + n_low + n_high + 4 * n_directory

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        start, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, index: int) -> int:
        """Number ``index``, from the directory entry before it and the bits after that."""
        at, seen = int(self.directory[index // SAMPLE]), index // SAMPLE * SAMPLE
        byte = at // 8
        size = SAMPLE
        while True:
            bits = np.unpackbits(self.high[byte : byte + size], bitorder="little")
            bits[: at - 8 * byte] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > index - seen:
                place = int(ones[index - seen]) + 8 * byte
                return self.base + ((place - index) << self.low_bits) + int(self._lows(index, index + 1)[0])
            size *= 2

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Numbers ``first`` up to ``last``, from the directory entry before the first; no others are decoded."""
        first, last = max(first, 0), max(last, 0)
        if last <= first:
            return np.empty(0, np.int64)
        block, stop = first // SAMPLE, -(-last // SAMPLE)
        low = int(self.directory[block])
        high = int(self.directory[stop]) if stop < len(self.directory) else 8 * len(self.high)
        bits = np.unpackbits(self.high[low // 8 : -(-high // 8)], bitorder="little")
        bits[: low % 8] = 0
        ones = np.flatnonzero(bits)[first - block * SAMPLE : last - block * SAMPLE].astype(np.int64) + low // 8 * 8
        return self.base + ((ones - np.arange(first, last)) << self.low_bits) + self._lows(first, last)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count].astype(np.int64)
        return self.base + ((ones - np.arange(self.count)) << self.low_bits) + self._lows(0, self.count)
