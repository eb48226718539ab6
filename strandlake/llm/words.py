"""Words and word hashes of whole texts, for use inside Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is what bytes.split() yields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Entries after which a worker's word cache is emptied.
CACHE_WORDS = 400_000
_U = np.uint64


class HashCache(dict):
    """word -> 64-bit hash, kept for one task; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products become well spread."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two adjacent windows."""
    return mix(left * _U(0xFF51AFD7ED558CCD) + (right ^ _U(0x2545F4914F6CDD1D)) * _U(0xC4CEB9FE1A85EC53))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` words, built by doubling: a window is two halves, and an odd word."""
    if len(h) < size:
        return h[:0]
    if size == 1:
        return mix(h)
    half = size // 2
    parts = windows(h, half)
    n = len(h) - size + 1
    two = joined(parts[:n], parts[half : half + n])
    return joined(two, h[2 * half : 2 * half + n]) if size % 2 else two


def digest128(words: list[bytes]) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of the word sequence."""
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one value at a time."""
    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py()


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of the given arrays."""
    ends = np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
