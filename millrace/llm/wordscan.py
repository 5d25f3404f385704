"""Array code over the text buffers of Arrow batches: word spans and word hashes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of
characters outside those code points. Work goes through a batch in slices of bounded bytes, so
memory follows the largest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
HASHED_BYTES = 1 << 18  # bytes of words that are hashed at once
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
# Two independent bases for hashes of word sequences.
SEQUENCE_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` powers of an odd base modulo 2^64 and of its inverse. One table is kept for
    a base, the longest so far."""
    if base not in _POWERS or len(_POWERS[base][0]) < count:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(count, b, dtype=np.uint64)
            steps[:1] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = out[0], out[1]
    ups, downs = _POWERS[base]
    return ups[:count], downs[:count]


def rounded(n: int) -> int:
    """The next power of two, so that few tables of powers are made."""
    return 1 << max(10, (n - 1).bit_length())


def prefix_hash(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``(sums[e] - sums[s]) * inverse[s]`` is the hash of values[s:e]."""
    ups, downs = powers(int(base), rounded(len(values) + 1))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * ups[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums, downs


@dataclass
class Words:
    """The words of consecutive texts. ``first[d]:first[d + 1]`` are those of text ``d``;
    ``starts`` and ``ends`` are byte positions in ``data``, ``bounds`` those of the texts."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; it depends on nothing else."""
        n = len(self.starts)
        out = np.empty(n, dtype=np.uint64)
        at = 0
        while at < n:
            # A block of words of bounded bytes, or one word that is longer.
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + HASHED_BYTES)))
            low = self.starts[at]
            sums, downs = prefix_hash(BYTE_CODE[self.data[low : self.ends[to - 1]]], BYTE_BASE)
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * downs[s] + (e - s).astype(np.uint64))
            at = to
        return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte bounds of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES, texts: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, bytes, bounds)`` of runs of up to ``texts`` texts that hold about ``limit`` bytes, one text at least."""
    data, bounds = text_buffers(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        to = min(rows, row + (texts or rows), max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1))
        yield row, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        row = to


def find_words(data: np.ndarray, bounds: np.ndarray, white: np.ndarray = WHITE) -> Words:
    """Runs of bytes outside ``white``; a run never crosses from one text to the next."""
    inside = ~white[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs, bit for bit."""
    return pa.array(x.view(np.int64))
