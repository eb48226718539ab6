"""Windows of reads looked up within Arrow batches, by places of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .packed import SEGMENT, all_windows, binaries, codes


def characters(data) -> tuple[np.ndarray, np.ndarray]:
    """(codes, leads): a code for each character of UTF-8 bytes, and which bytes begin one."""
    x = codes(data)
    leads = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
    return (x, leads) if leads.all() else (x[leads], leads)


def _buffers(column: pa.Array) -> Iterator:
    """The bytes of each value, None for null."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_buffer() if value.is_valid else None


def _stretches(x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(x) - k + 1, SEGMENT):
        yield at, x[at : at + SEGMENT + k - 1]


class Sorted:
    """Counters of a small table: packed k-mers in order, found by binary search."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, k: int, canonical: bool):
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts, self.k, self.canonical = keys[order], counts[order], k, canonical

    def counters(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first place, counters) of a code array, a stretch at a time; 0 where the window is invalid or absent."""
        for at, part in _stretches(x, self.k):
            keys, valid = all_windows(part, self.k, self.canonical)
            if not len(self.keys):
                yield at, np.zeros(len(keys), np.int64)
                continue
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            yield at, np.where(valid & (self.keys[found] == keys), self.counts[found], 0)


def hits(x: np.ndarray, table: Sorted) -> int:
    """Windows that the table holds."""
    return sum(int(np.count_nonzero(c)) for _, c in table.counters(x))


def first_below(x: np.ndarray, table: Sorted, n_min: int) -> int | None:
    """The first place whose counter is under n_min."""
    for at, c in table.counters(x):
        bad = c < n_min
        if bad.any():
            return at + int(bad.argmax())
    return None


def covered(bad: np.ndarray, k: int, size: int) -> np.ndarray:
    """Which of `size` symbols a bad window of k symbols covers."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(bad)
    edge[at] += 1
    edge[at + k] -= 1
    return np.cumsum(edge[:-1]) > 0


def masked(data, x: np.ndarray, leads: np.ndarray, table: Sorted, n_min: int) -> bytes:
    """The text with N for every character that a window with a counter under n_min covers."""
    raw = np.frombuffer(data, np.uint8)
    if len(x) < table.k:
        return raw.tobytes()
    gone = covered(np.concatenate([c < n_min for _, c in table.counters(x)]), table.k, len(x))
    if not leads.all():
        gone = gone[np.cumsum(leads) - 1]
        raw, gone = raw[leads | ~gone], gone[leads | ~gone]
    return np.where(gone, np.uint8(ord("N")), raw).tobytes()


def appended(index: int, name: str, kind: pa.DataType, value: Callable, table) -> Callable:
    """For mapInArrow over reads: all columns and one more, value(bytes, codes, leads, table) of column `index`; None for null.

    Reads are handed on once their sequences come to SEGMENT bytes, as a counter for each place takes many times the batch's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in batches:
            at, out, size = 0, [], 0
            for data in _buffers(batch.column(index)):
                out.append(None if data is None else value(data, *characters(data), held))
                size += len(data or b"")
                if size >= SEGMENT or at + len(out) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(out)).columns, pa.array(out, kind)], names=[*batch.schema.names, name])
                    at, out, size = at + len(out), [], 0

    return run


def places(k: int, canonical: bool) -> Callable:
    """For mapInArrow over (id, sequence): (id, pos, valid, packed) of every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, ok, keys, size = [], [], [], [], 0
            for row, data in enumerate(_buffers(batch.column(1))):
                for start, part in _stretches(characters(data)[0], k) if data is not None else ():
                    found, valid = all_windows(part, k, canonical)
                    rows.append(np.full(len(found), row))
                    at.append(np.arange(start, start + len(found)))
                    ok.append(valid)
                    keys.append(found)
                    size += len(found)
                    if size >= SEGMENT:
                        yield _placed(batch, rows, at, ok, keys)
                        rows, at, ok, keys, size = [], [], [], [], 0
            if rows:
                yield _placed(batch, rows, at, ok, keys)

    return run


def _placed(batch: pa.RecordBatch, rows: list, at: list, ok: list, keys: list) -> pa.RecordBatch:
    ids = batch.column(0).take(pa.array(np.concatenate(rows)))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(ok)), binaries(np.concatenate(keys))], names=["id", "pos", "valid", "packed"])


def cut(size: int) -> Callable:
    """For mapInArrow over (id, sequence): (id, at, part), parts of `size` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(_buffers(batch.column(1))):
                text = bytes(data).decode("utf-8", "replace") if data is not None else ""
                for at in range(0, len(text), size << 6):
                    starts = range(at, min(len(text), at + (size << 6)), size)
                    ids = batch.column(0).take(pa.array([row] * len(starts), pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array([text[s : s + size] for s in starts])], names=["id", "at", "part"])

    return run


def packed_keys(k: int) -> Callable:
    """For mapInArrow over (kmer, count): (packed, count) of k-mers as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = key_array([x for x in _buffers(batch.column(0))], k)
            yield pa.RecordBatch.from_arrays([binaries(keys), batch.column(1)], names=["packed", "count"])

    return run


def key_array(kmers: list, k: int) -> np.ndarray:
    """The packed keys of k-mers of k symbols each."""
    keys, _ = all_windows(codes(b"".join(kmers)), k, False)
    return np.ascontiguousarray(keys[::k])
