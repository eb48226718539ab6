"""Packed k-mers of whole Arrow batches: 2 bits a symbol, counted within the batch.

K-mers of up to 31 symbols are longs; longer ones, up to 256, are binaries of two to eight big-endian 64-bit words, whose order is
that of the k-mers. Sequences are cut into segments of SEGMENT symbols that share k - 1 with the next one, by slicing bytes, so the
time is in proportion to the length, however long a sequence is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Most symbols of a long, symbols of a word, and the largest k whose counters are held in an array of all k-mers.
PACKED, WORD, DENSE = 31, 32, 11
#: Symbols of a segment; different k-mers that a task holds before it hands them on.
SEGMENT, HELD = 1 << 18, 1 << 20

#: Number of each byte's symbol; 4 for all that breaks k-mers.
_CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODES[[ord(x) for x in _c]] = _i


def codes(data) -> np.ndarray:
    return _CODES[np.frombuffer(data, np.uint8)]


def compressed(x: np.ndarray) -> np.ndarray:
    """Equal neighbours collapsed; a run of whatever breaks k-mers is one break."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _widened(x: np.ndarray, k: int, join) -> np.ndarray:
    """Values of all windows of k symbols, by doubling; join(left, right, size of left, size of right)."""
    if k == 1:
        return x
    half = k // 2
    parts = _widened(x, half, join)
    n = len(x) - k + 1
    two = join(parts[:n], parts[half : half + n], half, half)
    return join(two, x[2 * half : 2 * half + n], 2 * half, 1) if k % 2 else two


def _forward(x: np.ndarray, k: int) -> np.ndarray:
    return _widened(x, k, lambda a, b, _, size: a << np.uint64(2 * size) | b)


def _reverse(x: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements of all windows."""
    return _widened(x ^ np.uint64(3), k, lambda a, b, size, _: a | b << np.uint64(2 * size))


def _words(x: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """(windows, words): the words of all windows, highest first; the last one holds what the others leave."""
    n, count = len(x) - k + 1, -(-k // WORD)
    rest = k - WORD * (count - 1)
    full, last = _forward(x, WORD), _forward(x, rest)
    out = np.stack([*(full[WORD * w : WORD * w + n] for w in range(count - 1)), last[WORD * (count - 1) :][:n]], axis=1)
    if canonical:
        full, last = _reverse(x, WORD), _reverse(x, rest)
        other = np.stack([*(full[k - WORD * (w + 1) :][:n] for w in range(count - 1)), last[:n]], axis=1)
        smaller, open_ = np.zeros(n, bool), np.ones(n, bool)
        for w in range(count):
            smaller |= open_ & (other[:, w] < out[:, w])
            open_ &= other[:, w] == out[:, w]
        out = np.where(smaller[:, None], other, out)
    return out


def all_windows(x: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid) of every place of a code array; keys are longs up to PACKED symbols, else fixed-width bytes."""
    if len(x) < k:
        return np.zeros(0, np.int64 if k <= PACKED else f"S{8 * -(-k // WORD)}"), np.zeros(0, bool)
    broken = np.concatenate([[0], np.cumsum(x == 4, dtype=np.int64)])
    valid = broken[k:] == broken[:-k]
    y = x.astype(np.uint64) & np.uint64(3)
    if k > PACKED:
        words = np.ascontiguousarray(_words(y, k, canonical).astype(">u8"))
        return words.view(f"S{8 * words.shape[1]}").ravel(), valid
    out = _forward(y, k)
    if canonical:
        out = np.minimum(out, _reverse(y, k))
    return out.view(np.int64), valid


def windows(data: bytes, k: int, canonical: bool) -> np.ndarray:
    """The packed valid k-mers of a byte string, in order; of a k-mer and its reverse complement the smaller one if canonical."""
    keys, valid = all_windows(codes(data), k, canonical)
    return keys[valid]


def segments(column: pa.Array, k: int, homopolymer: bool = False, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, place of the first symbol, codes) of the sequences of a column, cut with k - 1 symbols shared; nulls have none."""
    size = size or SEGMENT
    for row, value in enumerate(column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())):
        if value.is_valid:
            x = codes(value.as_buffer())
            x = compressed(x) if homopolymer else x
            for at in range(0, max(1, len(x) - k + 1), size):
                yield row, at, x[at : at + size + k - 1]


def binaries(keys: np.ndarray) -> pa.Array:
    """An Arrow column of keys: longs, or binaries of fixed-width bytes."""
    if keys.dtype == np.int64:
        return pa.array(keys)
    width = keys.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with the sums of their counts, 1 each by default."""
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = keys[order] if order is not None else np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


class Counts:
    """Mergeable counts of a task: an array of all k-mers for small k, else sorted keys with their counts."""

    def __init__(self, k: int):
        self.dense = np.zeros(4**k, np.int64) if k <= DENSE else None
        self.keys, self.counts, self.waiting, self.size = None, None, [], 0

    def add(self, keys: np.ndarray) -> None:
        if self.dense is not None:
            # Few keys are added at their places, many over the whole array.
            if len(keys) * 8 < len(self.dense):
                found, n = _counted(keys)
                self.dense[found] += n
            else:
                self.dense += np.bincount(keys, minlength=len(self.dense))
        elif len(keys):
            self.waiting.append(keys)
            self.size += len(keys)
            if self.size >= HELD:
                self.merge()

    def merge(self) -> None:
        if self.waiting:
            keys, counts = _counted(np.concatenate(self.waiting))
            if self.keys is not None:
                keys, counts = _counted(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
            self.keys, self.counts, self.waiting, self.size = keys, counts, [], 0

    def full(self) -> bool:
        return self.keys is not None and len(self.keys) >= HELD

    def taken(self) -> Iterator[pa.RecordBatch]:
        """All counts, which are then forgotten."""
        if self.dense is not None:
            keys = np.flatnonzero(self.dense)
            counts = self.dense[keys]
            self.dense[:] = 0
        else:
            self.merge()
            if self.keys is None:
                return
            keys, counts = self.keys, self.counts
            self.keys = self.counts = None
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([binaries(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["packed", "count"])


def packed_counts(k: int, canonical: bool, homopolymer: bool = False):
    """For mapInArrow over one column of sequences: (packed, count) of what a task holds, each k-mer once or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, small, size = Counts(k), [], 0
        gap = np.full(1, 4, np.uint8)

        def add() -> None:
            keys, valid = all_windows(np.concatenate(small), k, canonical)
            held.add(keys[valid])
            small.clear()

        for batch in batches:
            for _, _, x in segments(batch.column(0), k, homopolymer):
                # Short sequences are read together, with a break between them.
                small += [x, gap]
                size += len(x) + 1
                if size >= SEGMENT:
                    add()
                    size = 0
                    if held.full():
                        yield from held.taken()
        if small:
            add()
        yield from held.taken()

    return run


def type_of(k: int) -> str:
    return "long" if k <= PACKED else "binary"


def unpacked(k: int):
    """For mapInArrow over (packed binary, count): (kmer, count), for k-mers of more than PACKED symbols."""
    count = -(-k // WORD)
    rest = k - WORD * (count - 1)
    symbols = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), np.uint8).reshape(n, 8 * count)
            pairs = np.stack([raw >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(n, WORD * count)
            # The last word is filled from its lower end.
            text = symbols[np.concatenate([pairs[:, : WORD * (count - 1)], pairs[:, WORD * count - rest :]], axis=1)]
            kmers = pa.Array.from_buffers(pa.binary(k), n, [None, pa.py_buffer(text.tobytes())]).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([kmers, batch.column(1)], names=["kmer", "count"])

    return run


def _normalized(v: np.ndarray, r: np.ndarray, m: int) -> np.ndarray:
    """Of each packed m-mer and its reverse complement the smaller allowed one, else 4**m."""

    def allowed(x: np.ndarray) -> np.ndarray:
        # Not TT? nor TGT at the end, no AA but at the first symbol, not AAA nor ACA at the start.
        bad = ((x >> 2) & 15 == 15) | (x & 63 == 59) | (x >> 2 * (m - 3) == 0) | (x >> 2 * (m - 3) == 4)
        for p in range(1, m - 1):
            bad |= (x >> 2 * (m - 2 - p)) & 15 == 0
        return ~bad

    none = np.int64(4**m)
    return np.minimum(np.where(allowed(v), v, none), np.where(allowed(r), r, none))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` adjacent values."""
    n, width, low = len(x) - span + 1, 1, x
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[span - width : span - width + n])


def stretches(x: np.ndarray, k: int, m: int, size: int | None = None) -> tuple[np.ndarray, ...]:
    """(run, start in the run, length, signature) of the maximal stretches of k-mers of a code array that share a signature.

    Runs of valid symbols are numbered from 0. The array is read `size` windows at a time; a stretch may go on from one to the next.
    """
    size = size or SEGMENT
    starts = (x < 4) & np.concatenate([[True], x[:-1] == 4])
    first_of, firsts, sigs, ends = np.flatnonzero(starts), [], [], []
    before = np.int64(-1)
    for at in range(0, len(x) - k + 1, size):
        part = x[at : at + size + k - 1]
        y = part.astype(np.uint64) & np.uint64(3)
        sig = _least(_normalized(_forward(y, m).view(np.int64), _reverse(y, m).view(np.int64), m), k - m + 1)
        broken = np.concatenate([[0], np.cumsum(part == 4, dtype=np.int64)])
        # -1 stands for windows that hold a break; a stretch begins or ends where the value changes.
        sig = np.where(broken[k:] == broken[:-k], sig, -1)
        old = np.concatenate([[before], sig[:-1]])
        new = np.flatnonzero(sig != old)
        firsts.append(at + new[sig[new] >= 0])
        sigs.append(sig[new[sig[new] >= 0]])
        ends.append(at + new[old[new] >= 0])
        before = sig[-1]
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first, sig, end = np.concatenate(firsts), np.concatenate(sigs), np.concatenate(ends)
    if before >= 0:
        end = np.append(end, len(x) - k + 1)
    run = np.searchsorted(first_of, first, "right") - 1
    return run, first - first_of[run], end - first + k - 1, sig


def super_kmers(k: int, m: int, size: int | None = None):
    """For mapInArrow over (id, sequence): (id, run_no, start, length, signature)."""
    symbols = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], []
            for row, value in enumerate(batch.column(1).cast(pa.binary())):
                if value.is_valid:
                    held.append(stretches(codes(value.as_buffer()), k, m, size))
                    rows.append(np.full(len(held[-1][0]), row))
            if not held:
                continue
            runs, start, length, sig = (np.concatenate(c) for c in zip(*held))
            text = symbols[sig[:, None] >> np.arange(2 * (m - 1), -1, -2) & 3]
            names = pa.Array.from_buffers(pa.binary(m), len(sig), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary()).cast(pa.string())
            names = pa.compute.if_else(pa.array(sig == 4**m), "~", names)
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in (runs, start, length)), names], names=["id", "run_no", "start", "length", "signature"])

    return run
