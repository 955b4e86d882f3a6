"""Arrow text columns as flat word tables: starts, ends and 64-bit hashes of all words.

A batch is walked in groups of whole texts of about ``GROUP_BYTES``; the byte
arrays behind a word table exist for one slice of a group at a time, so a text of
any length costs its own bytes plus three numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_SLICE = 1 << 20
_POW: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) <= n:
        size = max(_SLICE, n) + 1
        base = 0x2545F4914F6CDD1D
        _POW[:] = [_powers(base, size), _powers(pow(base, -1, 1 << 64), size)]
    return _POW[0], _POW[1]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table over byte values, true inside the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: everything in ASCII but digits and letters
PUNCT = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def hash_bytes(word: bytes) -> int:
    """The hash a word table gives to these bytes."""
    _, _, h = _slice_words(np.frombuffer(word, dtype=np.uint8), np.zeros(256, dtype=bool), np.array([0]))
    return int(h[0]) if len(word) else 0


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, inverse)``: the substring [s, e) hashes to ``(sums[e]-sums[s]) * inverse[s]``."""
    power, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(_ODD))


def _slice_words(buf: np.ndarray, seps: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one slice; a word never crosses a position in ``cuts``."""
    inside = ~seps[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts >= 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums, inverse = prefix_hash(buf)
    return starts, ends, span_hash(sums, inverse, starts, ends)


def words_of(buf: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts that lie back to back in ``buf``."""
    if len(buf) <= _SLICE:
        return _slice_words(buf, seps, offsets)
    parts, at = [], 0
    while at < len(buf):
        to = min(at + _SLICE, len(buf))
        while to < len(buf) and not seps[buf[to]] and not seps[buf[to - 1]]:
            near = np.flatnonzero(seps[buf[to : to + 4096]])
            to = to + int(near[0]) if len(near) else min(to + 4096, len(buf))
        s, e, h = _slice_words(buf[at:to], seps, offsets - at)
        parts.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


@dataclass
class Group:
    """Whole texts of a batch, back to back."""

    first: int  # row of the first text in the batch
    buf: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text k is buf[offsets[k]:offsets[k + 1]]
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text k are [bounds[k], bounds[k + 1])

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.size), np.diff(self.bounds))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array without copying the text."""
    column = plain(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def text_runs(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row of the first text, bytes, offsets)`` of runs of whole texts of about ``size`` bytes."""
    buf, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def groups(column: pa.Array, seps: np.ndarray, fold: bool = False, size: int = GROUP_BYTES) -> Iterator[Group]:
    """Word tables of a text column; with ``fold`` A-Z are lower-cased first."""
    buf, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        part, cuts = buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if fold:
            part = LOWER[part]
        starts, ends, hashes = words_of(part, cuts[:-1], seps)
        yield Group(at, part, cuts, starts, ends, hashes, np.searchsorted(starts, cuts))
        at = to


def window_hashes(hashes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all runs of n words for each n; entry i starts at word i.

    Runs are put together from runs of powers of two, so a length costs a few
    array operations. The last n - 1 entries run over the end and are left out.
    """
    power, out = {1: hashes}, {}

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _U(0xD6E8FEB86659FD93) + b)

    for n in lengths:
        done, acc = 0, None
        for bit in (1 << k for k in range(n.bit_length() - 1, -1, -1)):
            if not n & bit:
                continue
            step = 1
            while step < bit:
                if 2 * step not in power:
                    base = power[step]
                    power[2 * step] = join(base[: len(base) - step], base[step:]) if len(base) > step else base[:0]
                step *= 2
            run = power[bit]
            if acc is None:
                acc = run
            else:
                tail = run[done:]
                acc = join(acc[: len(tail)], tail[: len(acc)])
            done += bit
        out[n] = acc[: max(0, len(hashes) - n + 1)]
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans in ascending order of their starts, slice by slice."""
    out = np.zeros(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(starts, low + _SLICE))
        high = int(ends[at:to].max())
        sums, inverse = prefix_hash(buf[low:high])
        out[at:to] = span_hash(sums, inverse, starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


class HashRows:
    """Row numbers of 64-bit hashes in a fixed table, -1 where absent."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)
