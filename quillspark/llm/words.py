"""Vectorised word scanner over Arrow string buffers.

Words are maximal runs of bytes that are not separators; A-Z counts as a-z. Each word gets a 64-bit hash (a
polynomial over a fixed random byte table, finished by a multiply-xorshift mixer), so no Python object is made per
word. Two different words share a hash with probability near 2**-64. A polynomial modulo 2**64 can be made to collide by
words of a thousand bytes and more that are built for it, so words over LONG bytes are hashed by BLAKE2 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values(cased: bool) -> np.ndarray:
    values = np.random.default_rng(20260101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if not cased:
        values[65:91] = values[97:123]
    return values


_VALUES = {cased: _byte_values(cased) for cased in (False, True)}
#: Bytes up to which a word's hash is a polynomial.
LONG = 512
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: The space alone.
SPACE = np.zeros(256, bool)
SPACE[32] = True
#: Every ASCII byte but letters, digits and the apostrophe.
NON_WORD = np.array([b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 32 * CHUNK_BYTES:
            return have
        _powers[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@dataclass
class Scan:
    """Words of documents first .. first+len(splits)-2 of a batch; document i owns words splits[i]:splits[i+1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    splits: np.ndarray
    sums: np.ndarray
    back: np.ndarray
    cased: bool = False

    @property
    def hashes(self) -> np.ndarray:
        out = mix64((self.sums[self.ends] - self.sums[self.starts]) * self.back[self.starts])
        for k in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            word = self.data[self.starts[k] : self.ends[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word if self.cased else word.lower(), digest_size=8).digest(), "little")
        return out

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hashes of the first bytes of each word, tagged with the length; whole words where they are no longer."""
        cut = np.minimum(self.starts + length, self.ends)
        return mix64((self.sums[cut] - self.sums[self.starts]) * self.back[self.starts] + np.uint64(length))

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.splits) - 1), np.diff(self.splits))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan(texts: pa.Array, separators: np.ndarray = WHITE, hashed: bool = True, cased: bool = False, cuts: np.ndarray | None = None) -> Iterator[Scan]:
    """Scans of the texts. With `cuts`, a (256, 256) table, a word also ends where cuts[byte, next byte] holds."""
    data, offsets = buffers(texts)
    for i, j in pieces(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(part)
        inside = ~separators[part]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        if cuts is not None and n > 1:
            edge[1:n] |= cuts.take((part[:-1].astype(np.int64) << 8) | part[1:])
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums, back = np.zeros(n + 1 if hashed else 0, np.uint64), None
        if hashed:
            np.cumsum(_VALUES[cased][part] * _power_table(_BASE, n)[:n], out=sums[1:])
            back = _power_table(_BASE_INVERSE, n + 1)
        yield Scan(i, part, offs, starts, ends, np.searchsorted(starts, offs), sums, back, cased)


class PieceTable:
    """Token ids of the pieces of text that a worker has met, by hash: whole arrays of pieces are looked up and their ids
    gathered at once; new pieces are encoded together and remembered. It starts afresh when it holds `most`."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_500_000):
        """encode: pieces to (their ids one after another, the number of ids of each)."""
        self.encode, self.most, self.bits = encode, most, max(12, int(2 * most).bit_length())
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.starts, self.flat, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.rows[slot]
        out = np.where(self.keys[slot] == hashes, row, -1)
        todo = np.flatnonzero((row >= 0) & (out < 0))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            row = self.rows[at]
            hit = (row >= 0) & (self.keys[at] == hashes[todo])
            out[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
        return out

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Distinct hashes that the table lacks; it has room for them."""
        new, lengths = self.encode(pieces)
        used, n = int(self.starts[self.count]), len(pieces)
        if self.count + n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(self.count + n + 1, np.int64)))
        if used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(used + len(new), np.uint32)))
        self.flat[used : used + len(new)] = new
        self.starts[self.count + 1 : self.count + n + 1] = used + np.cumsum(lengths)
        slot, todo = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(n)
        while len(todo):
            # Of the pieces that ask for a free place the first gets it, the others go on.
            at, first = np.unique(slot[todo], return_index=True)
            taken = todo[first[self.rows[at] < 0]]
            self.rows[slot[taken]], self.keys[slot[taken]] = self.count + taken, hashes[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.count += n

    def ids(self, s: Scan, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words `which` of a scan, one after another; the number of ids of each)."""
        hashes = s.hashes[which]
        # A slice holds no more words than the table, however long its document is.
        parts = [self._slice(s, which[at : at + self.most], hashes[at : at + self.most]) for at in range(0, len(which), self.most)]
        if len(parts) == 1:
            return parts[0]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (self.flat[:0], np.zeros(0, np.int64))

    def _slice(self, s: Scan, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self._find(hashes)
        absent = np.flatnonzero(row < 0)
        if len(absent):
            new, first = np.unique(hashes[absent], return_index=True)
            if self.count + len(new) > self.most:
                self._clear()
                absent = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            at = which[absent[first]]
            self._add(new, [s.data[a:b].tobytes() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist(), strict=True)])
            row[absent] = self._find(hashes[absent])
        lengths = self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[row] - (ends - lengths), lengths) + np.arange(total)], lengths


class HashIndex:
    """Open-addressing table from 64-bit hashes to positions 0..n-1, looked up for whole arrays."""

    def __init__(self, hashes: np.ndarray):
        self.shift = 64 - max(8, int(len(hashes) * 4).bit_length())
        size = 1 << (64 - self.shift)
        self.keys, self.rows, self.probes = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 1
        for row, h in enumerate(hashes.tolist()):
            slot, step = h >> self.shift, 1
            while self.rows[slot] >= 0:
                slot, step = (slot + 1) % size, step + 1
            self.keys[slot], self.rows[slot] = h, row
            self.probes = max(self.probes, step)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        slot = (hashes >> np.uint64(self.shift)).astype(np.int64)
        row = self.rows[slot]
        found = np.where((row >= 0) & (self.keys[slot] == hashes), row, -1)
        todo = np.flatnonzero((row >= 0) & (found < 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + step) % len(self.keys)
            row = self.rows[at]
            hit = (row >= 0) & (self.keys[at] == hashes[todo])
            found[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
        return found


def shingles(scan_: Scan, size: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word shingles; the whole sequence where it is shorter."""
    h = scan_.hashes
    n = len(h)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + h[k : n - size + 1 + k] if len(rolled) else rolled
    rolled = mix64(rolled)
    for a, b in zip(scan_.splits[:-1].tolist(), scan_.splits[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            value = b - a
            for x in h[a:b].tolist():
                value = (value * 0x2545F4914F6CDD1D + x) & 0xFFFFFFFFFFFFFFFF
            yield mix64(np.array([value ^ 0x5851F42D4C957F2D], np.uint64))
        else:
            yield rolled[:0]
