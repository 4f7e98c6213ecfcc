"""Words of whole texts as two independent 64-bit hashes, in numpy over the bytes of Arrow batches.

A word is a run of bytes other than space and tab to carriage return. It is read in lanes of eight
bytes, and each lane goes through a mixing step with the hash so far, for all words of a block at
once; the second hash has other constants. Stretches of words have Rabin-Karp hashes over the hashes
of their words. A block holds whole words of at most about a megabyte; only a longer single word makes
a longer block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes of texts that are worked on at once.
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks for the last lane of a word, by its number of bytes.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text begins and ends in them; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _block(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    """Both hashes, first and last+1 byte of the words of a block; a word also ends at each break."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] |= ~space[breaks]
    last = ~space
    last[:-1] &= space[1:]
    last[breaks - 1] |= ~space[breaks - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return *_hashes(_LOWER[data] if lower else data, starts, ends), starts, ends


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each stretch of bytes, lane by lane over all stretches that are long enough."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    size = ends - starts
    h, g = mix(size.astype(np.uint64), 21), mix(size.astype(np.uint64), 22)
    at, left, who = starts, size, slice(None)
    while len(left):
        lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel() & _LANE[np.minimum(left, 8)]
        h[who], g[who] = mix(h[who] ^ lane, 23), mix(g[who] + mix(lane, 24), 25)
        more = np.flatnonzero(left > 8)
        who = more if isinstance(who, slice) else who[more]
        at, left = at[more] + 8, left[more] - 8
    return h, g


class Words:
    """The words of consecutive texts: hashes h and g, and of text i the words first[i] to first[i+1]."""

    def __init__(self, h: np.ndarray, g: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.h, self.g, self.starts, self.ends, self.first = h, g, starts, ends, first

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words and the word each begins at; none crosses texts."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = rolling(self.h, k, seed)
        owner = self.text_of_word()
        at = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return h[at], at


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of the windows of k values."""
    n = len(h) - k + 1
    base = np.uint64((_BASE * (2 * seed + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * base + h[j : n + j]
    return mix(acc, seed)


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces with about ``most`` bytes of texts, one longer text by itself."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(name))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def giving_back(run: Callable) -> Callable:
    """A function over batches that in the end returns to the system what its allocators hold unused.

    Python workers outlive their tasks: without this, one that waits keeps the most that any task took.
    """

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return through


def text_groups(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Words of the texts from i to j (exclusive), a block's worth of texts at a time."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        yield i, j, _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    parts = []
    for a, b in _cuts(data):
        h, g, starts, ends = _block(data[a:b], offsets - a, lower)
        parts.append((h, g, starts + a, ends + a))
    h, g, starts, ends = (np.concatenate(x) for x in zip(*parts)) if parts else _block(data, offsets, lower)
    return Words(h, g, starts, ends, np.searchsorted(starts, offsets))


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks that end behind white space, where there is any."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and not _SPACE[data[b - 1]]:
            ahead = np.flatnonzero(_SPACE[data[b : b + BLOCK]])
            b = b + int(ahead[0]) + 1 if len(ahead) else min(n, b + BLOCK)
        yield a, b
        a = b


def words_of(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """Word hashes of one text."""
    column = pa.array([text.decode() if isinstance(text, bytes) else text], pa.string())
    return np.concatenate([w.h for _, _, w in text_groups(column, lower)])
