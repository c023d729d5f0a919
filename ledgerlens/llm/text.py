"""Words of whole texts as 64-bit hashes, straight from Arrow's UTF-8 buffers.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial of its bytes modulo 2^64 through prefix
sums, then mixed; a window's hash is the same over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
# Odd constants of the polynomial and of the mixing steps (fixed values of public hash functions).
BASE, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n; kept and doubled as needed."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices with about ``limit`` bytes; a longer text is one
    slice. Nulls are empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


class Words:
    """Words of one slice: ``starts``/``ends`` in bytes, ``offsets`` of each row's words, ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.rows = len(offsets) - 1
        inside = ~SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data):
            before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
            after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
            self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.offsets = np.searchsorted(self.starts, offsets)
        up, down = powers(len(data) + 1)
        values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, across rows: callers cut at ``offsets``."""
        return window_hashes(self.hashes, k)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * down[:n - k + 1] + np.uint64(k))
