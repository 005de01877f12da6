"""Vectorised text primitives on Arrow string buffers.

Every text operator of this subpackage sees documents as UTF-8 bytes in one
Arrow batch.  The word and line definitions used here only name ASCII
separators, and all bytes of a multi-byte code point are >= 0x80, so words and
lines can be cut on bytes without decoding anything.

A span is hashed as a polynomial over random 64-bit byte values, taken from a
running sum, so hashing all words of a batch costs a few numpy passes over its
bytes and no Python per word.  ``lane`` picks one of two independent families;
both lanes together make a 128-bit identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once: the work arrays of 8 bytes a byte stay in cache.
CHUNK_BYTES = 1 << 19

#: Bits of the table that a sieve asks before its sorted hashes.
SIEVE_BITS = 22

MASK64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SEEDS = (0x5EED, 0xBEEF)


def _flags(ranges) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~_flags([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z is lower-cased
ALNUM = ~_flags([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: first bytes of code points
LEADS = ~_flags([(0x80, 0xBF)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Lane:
    """Byte values and powers of one hash family."""

    def __init__(self, lane: int):
        rng = np.random.default_rng(_SEEDS[lane])
        self.base = _BASES[lane]
        self.plain = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.folded = self.plain.copy()
        self.folded[65:91] = self.plain[97:123]
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(2 * CHUNK_BYTES, n + 1)
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_LANES: list[_Lane] = []


def _lane(lane: int) -> _Lane:
    if not _LANES:
        _LANES.extend(_Lane(k) for k in range(len(_BASES)))
    return _LANES[lane]


@dataclass
class Chunk:
    """Some whole rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` is row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    sums: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def running(self, fold: bool, lane: int) -> np.ndarray:
        if (fold, lane) not in self.sums:
            family = _lane(lane)
            family.grow(len(self.data))
            values = (family.folded if fold else family.plain)[self.data]
            values *= family.power[: len(values)]
            total = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values, out=total[1:])
            self.sums[fold, lane] = total
        return self.sums[fold, lane]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool, lane: int = 0) -> np.ndarray:
        """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
        total = self.running(fold, lane)
        out = total[ends] - total[starts]
        out *= _lane(lane).inverse[starts]
        return mix(out + (ends - starts).astype(np.uint64))

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of member bytes, cut at row borders."""
        inside = member[self.data]
        edge = np.empty(len(inside) + 1, dtype=bool)
        edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        starts, ends = at[0::2], at[1::2]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return starts, ends

    def per_row(self, starts: np.ndarray) -> np.ndarray:
        """Index of the first span of each row, and at the end their count."""
        return np.searchsorted(starts, self.offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows in order, as many at once as hold ``size`` bytes (one at least)."""
    data, off = text_buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield Chunk(at, data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; callers mask runs that cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0xA0761D6478BD642F)
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


def grams(words: np.ndarray, row_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside one row, and their first words' indices."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row_of[: len(words) - n + 1] == row_of[n - 1 :])
    return gram_hashes(words, n)[at], at


class Sieve:
    """Sorted distinct hashes behind a bit table: most hashes of most texts end at one bit."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.seen = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.seen[tokens >> np.uint64(64 - SIEVE_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that hold a token, and the tokens' indices."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - SIEVE_BITS)])
        index = np.searchsorted(self.tokens, hashes[at])
        index[index == len(self.tokens)] = 0
        good = self.tokens[index] == hashes[at] if len(self.tokens) else np.zeros(len(at), bool)
        return at[good], index[good]
