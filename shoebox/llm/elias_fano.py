"""Elias-Fano coding of non-decreasing sequences, with select, in numpy.

A value's low bits are stored packed; its high part becomes a one in a bit vector, after as many zeros
as the high part counts. n values under u take about n * (2 + log2(u / n)) bits. `select` finds the
i-th one from a sample of positions (every SAMPLE-th one, 32 bits each) and a popcount over a few bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 256
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray  # bytes of the packed low parts, first bit lowest
    high: np.ndarray  # bytes of the unary bit vector, first bit lowest
    sample: np.ndarray  # uint32 positions of ones 0, SAMPLE, 2 * SAMPLE, ...

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: uint64, non-decreasing."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        flags = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        unary[at] = 1
        return cls(n, bits, np.packbits(flags.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.sample[i // SAMPLE])
        left = i % SAMPLE  # ones to pass after the sampled one
        byte = at >> 3
        seen = int(_ONES[int(self.high[byte]) >> (at & 7)]) - 1  # ones after the sampled one in its byte
        shift = (at & 7) + 1
        if left > seen:
            left -= seen
            byte += 1
            shift = 0
            while (own := int(_ONES[self.high[byte]])) < left:
                left -= own
                byte += 1
        elif left == 0:
            return (at - i << self.low_bits) | int(self._low(np.array([i]))[0])
        rest, pos = int(self.high[byte]) >> shift, (byte << 3) + shift
        while True:
            if rest & 1:
                left -= 1
                if not left:
                    break
            rest >>= 1
            pos += 1
        return (pos - i << self.low_bits) | int(self._low(np.array([i]))[0])

    def decode(self) -> np.ndarray:
        """All values."""
        i = np.arange(self.n)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) if self.n else i
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.sample))
        return head + self.low.tobytes() + self.high.tobytes() + self.sample.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, high, samples = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        part = lambda k, m: np.frombuffer(data, np.uint8, m, k)
        return cls(n, bits, part(at, low), part(at + low, high), np.frombuffer(data, "<u4", samples, at + low + high))
