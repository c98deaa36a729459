"""Elias-Fano sequences: n non-decreasing numbers below u in about n * (2 + log2(u / n)) bits, with select."""

from __future__ import annotations

import struct

import numpy as np

#: One place in every so many set bits of the upper part is kept, so that select counts few bytes.
SAMPLE = 256
_HEAD = struct.Struct("<QQB")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)
#: The place of the k-th set bit of each byte.
_PLACES = np.argsort(1 - _BITS, axis=1, kind="stable")


def encode(values: np.ndarray) -> bytes:
    """Header (count, last number, low bits), packed low bits, upper bits in unary, 32-bit select samples."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    last = int(v[-1]) if n else 0
    low = max(0, ((last + 1) // n).bit_length() - 1) if n else 0
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    uppers = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, last, low) + struct.pack("<QQQ", len(lows), len(uppers), len(samples)) + lows + uppers + samples


class EliasFano:
    """A view of an encoded sequence that starts at byte `at`; `end` is the byte after it."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, self.last, self.low = _HEAD.unpack_from(data, at)
        a, b, c = struct.unpack_from("<QQQ", data, at + _HEAD.size)
        at += _HEAD.size + 24
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.uppers = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        self.end = at + a + b + c

    def __len__(self) -> int:
        return self.n

    def _low_bits(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        chunk = int.from_bytes(self.lows[first // 8 : (last + 7) // 8].tobytes(), "little")
        return chunk >> first % 8 & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += bin(int(self.uppers[byte]) & (1 << at % 8) - 1).count("1")
        while left >= (ones := int(_ONES[self.uppers[byte]])):
            left -= ones
            byte += 1
        bit = np.flatnonzero(np.unpackbits(self.uppers[byte : byte + 1], bitorder="little"))[left]
        return (byte * 8 + int(bit) - i) << self.low | self._low_bits(i)

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The numbers at many places: one count of set bits by bytes finds the byte of each, a table its bit there."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.uint64)
        before = np.concatenate(([0], np.cumsum(_ONES[self.uppers])))
        byte = np.searchsorted(before, at, "right") - 1
        bit = _PLACES[self.uppers[byte], at - before[byte]]
        high = (byte * 8 + bit - at).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        # The low bits lie in nine bytes at most.
        first = at * self.low
        padded = np.concatenate((self.lows, np.zeros(9, np.uint8)))
        word = np.zeros(len(at), np.uint64)
        for i in range(8):
            word |= padded[first // 8 + i].astype(np.uint64) << np.uint64(8 * i)
        shift = (first % 8).astype(np.uint64)
        over = padded[first // 8 + 8].astype(np.uint64)
        word = word >> shift | np.where(shift > 0, over << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return high | word & np.uint64((1 << self.low) - 1)
