"""Words and their 64-bit hashes for whole Arrow text columns, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. Its hash is a polynomial in an odd base modulo
2**64, taken for all words at once from one running sum over the bytes, then mixed. The hash
depends on the word's bytes alone, so it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b ^ U64(0xA5A5A5A5A5A5A5A5)))


@dataclass
class Chunk:
    """Consecutive rows of a batch. `offsets[i]:offsets[i + 1]` are row i's bytes in `data`."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def pieces(self, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes that are not `apart`, within rows."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(apart, out=inside[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and `at`: row i has the words at[i]:at[i + 1]."""
        starts, ends = self.pieces(SPACE[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array, lower: bool = False, most: int = 1 << 20) -> Iterator[Chunk]:
    """The column's rows in order, some `most` bytes at a time; a longer text comes alone and whole."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        part = data[offsets[i] : offsets[j]]
        yield Chunk(i, LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
        i = j


def valid(c: Chunk) -> Chunk:
    """The chunk with replacement characters where its bytes are no UTF-8."""
    try:
        c.data.tobytes().decode()
        return c
    except UnicodeDecodeError:
        rows = [c.data[s:e].tobytes().decode(errors="replace").encode() for s, e in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)]
        return Chunk(c.first, np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))


def windows(word_hash: np.ndarray, at: np.ndarray, n: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, in order, and `at` for them.

    A row with fewer than n words has none, or with `whole` one of all its words (none if it has no word).
    """
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    rolled = word_hash[: max(0, len(word_hash) - n + 1)]
    for k in range(1, n):
        rolled = join2(rolled, word_hash[k : len(word_hash) - n + 1 + k])
    keep = np.zeros(len(rolled) + 1, np.int32)
    has = full > 0
    np.add.at(keep, at[:-1][has], 1)
    np.add.at(keep, (at[:-1] + full)[has], -1)
    out = rolled[np.cumsum(keep[:-1]) > 0]
    number = full
    if whole and (short := (count > 0) & (count < n)).any():
        number = np.where(short, 1, full)
        where = np.concatenate([[0], np.cumsum(number)])
        merged = np.empty(where[-1], U64)
        mask = np.ones(where[-1], bool)
        mask[where[:-1][short]] = False
        merged[mask] = out
        for i in np.flatnonzero(short):
            own = word_hash[at[i] : at[i + 1]]
            h = own[:1]
            for k in range(1, len(own)):
                h = join2(h, own[k : k + 1])
            merged[where[i]] = h[0] ^ U64(len(own))
        out = merged
    return out, np.concatenate([[0], np.cumsum(number)])
