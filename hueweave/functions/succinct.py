"""Bit vectors with a rank directory, and ascending numbers by Elias and Fano, read in place.

Both are read through ``read(at, n)``, which gives n bytes from a place on, so that one access to a file reads
a few bytes of it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

Read = Callable[[int, int], bytes]

#: Bits of a block of the directory, and bytes of one of its entries.
BLOCK, ENTRY = 512, 8


def packed_bits(bits: np.ndarray) -> bytes:
    """Bits, lowest first, padded with zeros to whole blocks."""
    return np.packbits(np.pad(bits.astype(np.uint8), (0, -len(bits) % BLOCK)), bitorder="little").tobytes()


def directory(packed: bytes) -> np.ndarray:
    """The set bits before each block, and of all."""
    ones = np.bitwise_count(np.frombuffer(packed, np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


class BitVector:
    """n bits: whole blocks, then their directory, from byte ``at`` on."""

    def __init__(self, read: Read, n: int, at: int = 0):
        self.read, self.n, self.at = read, n, at
        self.blocks = -(-n // BLOCK)
        self.entries = at + self.blocks * BLOCK // 8

    @staticmethod
    def pack(bits: np.ndarray) -> bytes:
        packed = packed_bits(bits)
        return packed + directory(packed).astype("<i8").tobytes()

    @property
    def size(self) -> int:
        """Bytes in all."""
        return self.blocks * BLOCK // 8 + (self.blocks + 1) * ENTRY

    def _before(self, block: int) -> int:
        return int.from_bytes(self.read(self.entries + block * ENTRY, ENTRY), "little")

    def _block(self, block: int) -> int:
        return int.from_bytes(self.read(self.at + block * BLOCK // 8, BLOCK // 8), "little")

    def rank(self, i: int) -> int:
        """Set bits among the first i."""
        if not 0 <= i <= self.n:
            raise IndexError(i)
        block, rest = divmod(i, BLOCK)
        return self._before(block) + ((self._block(block) & (1 << rest) - 1).bit_count() if rest else 0)

    def select(self, j: int) -> int:
        """Place of set bit j, from 0."""
        low, high = 0, self.blocks
        if not 0 <= j < self._before(high):
            raise IndexError(j)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._before(mid) <= j else (low, mid)
        bits, j = self._block(low), j - self._before(low)
        a, b = 0, BLOCK
        while b - a > 1:  # the half that holds it
            mid = (a + b) // 2
            ones = ((bits >> a) & (1 << mid - a) - 1).bit_count()
            a, b, j = (mid, b, j - ones) if ones <= j else (a, mid, j)
        return low * BLOCK + a


HEAD = struct.Struct("<QQQ")


class Monotone:
    """Ascending numbers from 0 on, repeats allowed: their low bits packed, the rest a bit vector of gaps in unary."""

    def __init__(self, read: Read, at: int = 0):
        self.read, self.at = read, at + HEAD.size
        self.n, self.low, upper = HEAD.unpack(read(at, HEAD.size))
        self.upper = BitVector(read, upper, self.at + -(-self.n * self.low // 8))

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.int64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        low = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        lows = np.concatenate([((v[i : i + 65536, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() for i in range(0, max(n, 1), 65536)])
        upper = np.zeros(n + (most >> low) + 1, bool)
        upper[(v >> low) + np.arange(n)] = True
        return HEAD.pack(n, low, len(upper)) + np.packbits(lows, bitorder="little").tobytes() + BitVector.pack(upper)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        begin = i * self.low
        lows = int.from_bytes(self.read(self.at + begin // 8, (begin % 8 + self.low + 7) // 8), "little") >> begin % 8
        return (self.upper.select(i) - i << self.low) | (lows & (1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """Every number, in time linear in the bits."""
        packed = np.frombuffer(self.read(self.upper.at, self.upper.blocks * BLOCK // 8), np.uint8)
        high = np.flatnonzero(np.unpackbits(packed, bitorder="little")) - np.arange(self.n)
        lows = np.unpackbits(np.frombuffer(self.read(self.at, -(-self.n * self.low // 8)), np.uint8), bitorder="little")[: self.n * self.low]
        out = high << self.low
        for i in range(self.low):
            out |= lows[i :: self.low].astype(np.int64) << i
        return out
