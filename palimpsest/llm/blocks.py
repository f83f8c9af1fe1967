"""Words of text columns inside tasks: byte tables and 64-bit word hashes, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # texts handled at once; a longer text is one slice of its own
BLOCK_BYTES = 1 << 20  # bytes hashed at once; blocks end at a separator
_BASE = 0x9E3779B97F4A7C15 | 1
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true inside the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`; every byte of a longer code point belongs to a word.
VISIBLE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
LETTERS = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept up to one block."""
    inverse = pow(_BASE, -1, 1 << 64)
    if n > 2 * BLOCK_BYTES:
        return _powers(_BASE, n), _powers(inverse, n)
    if not _TABLES:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, 2 * BLOCK_BYTES), _powers(inverse, 2 * BLOCK_BYTES)
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows that hold about SLICE_BYTES together; nulls become empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


class Words:
    """Words of a slice in reading order: `hashes`, byte places `starts` and `ends`, and `bounds`, the
    first word of each text (one more entry than texts). `data` holds the lower-cased bytes."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray) -> None:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        self.data = data = LOWER[raw[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        inside = is_word[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        before[offsets] = False  # a text starts anew
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        after[offsets] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        first = 0
        while first < len(self.starts):
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + BLOCK_BYTES, "right")))
            stop = self.ends[last - 1]
            up, down = _tables(int(stop - begin))
            sums = np.zeros(stop - begin + 1, dtype=np.uint64)
            np.cumsum(_SEEDS[data[begin:stop]] * up[: stop - begin], out=sums[1:], dtype=np.uint64)
            s, e = self.starts[first:last] - begin, self.ends[first:last] - begin
            self.hashes[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            first = last

    def texts(self, first: int, last: int) -> str:
        """Words [first, last) with one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last])).decode("utf-8", "replace")

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at every word, and flags of the words where all k stand in one text."""
        n, h = len(self.hashes), self.hashes
        room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n) >= k
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out *= np.uint64(_BASE)
            out[: max(n - i, 0)] += h[i:]
        return mix(out), room
