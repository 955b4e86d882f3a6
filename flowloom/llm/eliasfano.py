"""Elias-Fano coding of ascending integers with select.

A value is cut into low bits, packed side by side, and a high part, written as one
set bit per value in a bit array. The position of the i-th set bit gives the high part
back; counts of set bits per block of 2,048 bits, 32 bits each, make that a search
and one block. Space is about ``2 + log2(universe / n)`` bits a value.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
_HEAD = np.dtype([("n", "<u8"), ("low_bits", "<u4"), ("blocks", "<u4"), ("base", "<i8"), ("high_bytes", "<u8"), ("low_bytes", "<u8")])


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits or not len(values):
        return np.zeros(0, np.uint8)
    table = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(table.astype(np.uint8).ravel(), bitorder="little")


def encode(values: np.ndarray) -> bytes:
    """Bytes of ascending int64 values."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    base = int(values[0]) if n else 0
    rest = (values - base).astype(np.uint64)
    universe = int(rest[-1]) + 1 if n else 1
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = np.concatenate([_pack(rest[at : at + 65536] & np.uint64((1 << low_bits) - 1), low_bits) for at in range(0, max(n, 1), 65536)])
    place = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    size = -(-(int(place[-1]) + 1 if n else 1) // BLOCK) * BLOCK
    bits = np.zeros(size, dtype=bool)
    bits[place] = True
    counts = np.bincount(place // BLOCK, minlength=size // BLOCK)
    before = (np.cumsum(counts) - counts).astype("<u4")
    high = np.packbits(bits, bitorder="little")
    head = np.array([(n, low_bits, len(before), base, len(high), len(low))], dtype=_HEAD)
    return head.tobytes() + before.tobytes() + high.tobytes() + low.tobytes()


class EliasFano:
    """Random access to encoded values."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        self.n, self.low_bits, self.base = int(head["n"]), int(head["low_bits"]), int(head["base"])
        at = _HEAD.itemsize
        self.before = np.frombuffer(data, "<u4", int(head["blocks"]), at)
        at += self.before.nbytes
        self.high = np.frombuffer(data, np.uint8, int(head["high_bytes"]), at)
        at += self.high.nbytes
        self.low = np.frombuffer(data, np.uint8, int(head["low_bytes"]), at)

    def __len__(self) -> int:
        return self.n

    def _lows(self, first: int, n: int) -> np.ndarray:
        if not self.low_bits or not n:
            return np.zeros(n, np.int64)
        start, stop = first * self.low_bits, (first + n) * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: n * self.low_bits]
        return bits.reshape(n, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def _places(self, block: int) -> np.ndarray:
        part = self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        return np.flatnonzero(np.unpackbits(part, bitorder="little")) + block * BLOCK

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        place = int(self._places(block)[i - int(self.before[block])])
        return self.base + ((place - i) << self.low_bits) + int(self._lows(i, 1)[0])

    def runs(self):
        """All values in order, one block's worth at a time."""
        for block in range(len(self.before)):
            first = int(self.before[block])
            place = self._places(block)
            if len(place):
                high = place - np.arange(first, first + len(place))
                yield self.base + (high << self.low_bits) + self._lows(first, len(place))

    def values(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.runs()])
