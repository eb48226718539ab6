"""A mergeable sketch of k-mer counts: hashes of canonical k-mers, sampled and gathered in counters.

A window's hash is a polynomial in its symbols' random numbers, modulo 2**64, put together by doubling; that of its reverse
complement comes from the same symbols in the other order. The smaller of the two is scrambled. A window is sampled where the top
`sample_bits` of its hash are all zero (copy 0) or all one (copy 1); the next `slot_bits` name its counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .packed import SEGMENT, Counts, _widened, segments

#: Random odd numbers for A, C, G, T, and the base of the polynomial; arbitrary, the same for all sketches.
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, 4, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Every bit made to depend on all: two rounds of shift and multiplication."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def hashes(x: np.ndarray, k: int) -> np.ndarray:
    """The canonical hash of every valid window of a code array, in order."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    broken = np.concatenate([[0], np.cumsum(x == 4, dtype=np.int64)])
    y = x & 3
    forward = _widened(_SEEDS[y], k, lambda a, b, na, nb: a * _power(nb) + b)
    reverse = _widened(_SEEDS[3 - y], k, lambda a, b, na, nb: a + b * _power(na))
    return _scrambled(np.minimum(forward, reverse)[broken[k:] == broken[:-k]])


def slots(found: np.ndarray, sample_bits: int, slot_bits: int) -> np.ndarray:
    """Of the sampled hashes, copy * 2**slot_bits + slot."""
    top = found >> np.uint64(64 - sample_bits)
    ones = top == (1 << sample_bits) - 1
    keep = ones | (top == 0)
    slot = found[keep] << np.uint64(sample_bits) >> np.uint64(64 - slot_bits)
    return (slot + (ones[keep].astype(np.uint64) << np.uint64(slot_bits))).astype(np.int64)


def sketched(k: int, sample_bits: int, slot_bits: int, homopolymer: bool = False):
    """For mapInArrow over one column of sequences: (packed, count), a slot and the windows of a task that fell into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slots are kept like k-mers too many for an array.
        held, small, size = Counts(32), [], 0
        gap = np.full(1, 4, np.uint8)
        for batch in batches:
            for _, _, x in segments(batch.column(0), k, homopolymer):
                small += [x, gap]
                size += len(x) + 1
                if size >= SEGMENT:
                    held.add(slots(hashes(np.concatenate(small), k), sample_bits, slot_bits))
                    small, size = [], 0
                    if held.full():
                        yield from held.taken()
        if small:
            held.add(slots(hashes(np.concatenate(small), k), sample_bits, slot_bits))
        yield from held.taken()

    return run


def solved(filled: np.ndarray, n_slots: int, sample_bits: int) -> tuple[float, np.ndarray]:
    """(F0, f) of one copy, f[i - 1] the k-mers of count i, from the numbers of slots with counters 1, 2, ...

    A slot's different k-mers are taken as Poisson with mean m, so its counter is a compound Poisson sum: with p[i] the share of
    slots with counter i and q[j] the share of k-mers with count j, p[0] = exp(-m) and i p[i] = m * sum over j of j q[j] p[i - j].
    The equations are solved for q one after another.
    """
    empty = n_slots - filled.sum()
    if empty <= 0:
        raise ValueError("all counters of the sketch are taken: raise sample_bits or slot_bits")
    p = np.concatenate([[empty], filled]) / n_slots
    mean = -np.log(p[0])
    if mean == 0:
        return 0.0, np.zeros(len(filled))
    weighted = np.zeros(len(p))  # j q[j]
    for i in range(1, len(p)):
        weighted[i] = (i * p[i] / mean - weighted[1:i] @ p[i - 1 : 0 : -1]) / p[0]
    total = mean * n_slots * 2.0**sample_bits
    return total, total * weighted[1:] / np.arange(1, len(p))
