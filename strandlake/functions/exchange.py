"""Super-k-mers in packed bytes, exchanged in place of k-mers, and the k-mers of one part counted.

A k-mer's minimizer is the canonical m-mer of least hash, of those whose least inner s-mer is the middle one if there are such: they
lie further apart, so that stretches are longer. Adjacent k-mers that share it go together, at most k - m + 1 of them, as
one row of bytes: the number of k-mers, then the symbols, 2 bits each, the rest 0. The minimizer decides the part, so a k-mer and its
reverse complement meet in one part wherever they stand. Equal rows of a task are merged, with their number, before they are handed on.

The k-mers of a part come out in the order of the super-k-mers they stand in, not in their own: neighbours then mostly share all symbols
but one or two at the ends, and whoever writes and compresses them writes fewer bytes. This holds for a part of any size: it is counted
in lots of whole minimizers, and where one minimizer has too many k-mers, they are first counted in turns and then made again in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .packed import PACKED, SEGMENT, WORD, _forward, _least, _reverse, binaries, segments

#: Bytes of rows that a task holds before it hands them on, and rows whose k-mers are made at a time.
HELD_BYTES, ROWS = 1 << 25, 1 << 15
#: Bytes of the k-mers that a part's counts are made of at a time; those of one minimizer that has more are read in several turns, by their hash.
TURN_BYTES = 1 << 25
#: Bits of a k-mer's place in its row, whose number of k-mers is one byte.
PLACE_BITS = 8
_U = np.uint64
#: The bits of a byte that its first 0 to 4 symbols take.
_KEPT = np.array([0, 0xC0, 0xF0, 0xFC, 0xFF], np.uint8)
#: The four symbols of each byte.
_FOURS = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3].copy().view(np.uint32).ravel()


def minimizer_size(k: int) -> int:
    # Shorter ones make longer stretches, but too few are to be dealt to the parts.
    return min(11, k // 2, max(9, k // 3))


def row_size(k: int) -> int:
    """Bytes of a row: the number of k-mers, at most `span`, and their symbols."""
    span = k - minimizer_size(k) + 1
    return 1 + -(-(k + span - 1) // 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> _U(33))) * _U(factor)
    return x ^ (x >> _U(33))


def _lows(x: np.ndarray, k: int) -> np.ndarray:
    """What tells the minimizer of each window of k symbols; equal for a k-mer and its reverse complement."""
    m = minimizer_size(k)
    s = 4 - m % 2  # m - s is even, so both strands have one middle
    y = x.astype(_U) & _U(3)
    outer, inner = (_mixed(np.minimum(_forward(y, size), _reverse(y, size))) for size in (m, s))
    middle = inner[(m - s) // 2 :][: len(outer)] == _least(inner, m - s + 1)
    return _least(outer >> _U(1) | (~middle).astype(_U) << _U(63), k - m + 1)


def super_rows(x: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, row of bytes) of the super-k-mers of a code array."""
    span = k - minimizer_size(k) + 1
    size = row_size(k) - 1
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int32), np.zeros((0, 1 + size), np.uint8)
    low = _lows(x, k)
    broken = np.concatenate([[0], np.cumsum(x == 4, dtype=np.int64)])
    valid = broken[k:] == broken[:-k]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    at, count = at[valid[at]], count[valid[at]]
    # A longer stretch is cut into rows of `span` k-mers.
    pieces = -(-count // span)
    first = np.cumsum(pieces) - pieces
    skip = (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * span
    at, count = np.repeat(at, pieces) + skip, np.minimum(np.repeat(count, pieces) - skip, span)
    four = np.concatenate([x & 3, np.zeros(4 * size + 3, np.uint8)])
    four = four[:-3] << 6 | four[1:-2] << 4 | four[2:-1] << 2 | four[3:]
    rows = np.empty((len(at), 1 + size), np.uint8)
    rows[:, 0] = count
    for j in range(size):
        rows[:, 1 + j] = four[at + 4 * j] & _KEPT[np.clip(count + k - 1 - 4 * j, 0, 4)]
    return (_mixed(low[at]) % _U(parts)).astype(np.int32), rows


def _order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order in which equal tuples of words stand together, and where each begins."""
    n = len(words[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = words[0]
    for w in words[1:]:
        key = _mixed(key) + w
    order = np.argsort(key)
    key = key[order]
    new = key[1:] != key[:-1]
    if len(words) > 1:
        other = np.zeros(n - 1, bool)
        for w in words:
            w = w[order]
            other |= w[1:] != w[:-1]
        if (other & ~new).any():  # different tuples of one hash
            order, other = np.lexsort(words), np.zeros(n - 1, bool)
            for w in words:
                w = w[order]
                other |= w[1:] != w[:-1]
        new = other
    return order, np.flatnonzero(np.concatenate([[True], new]))


def _summed(words: list[np.ndarray], counts: np.ndarray, *places: np.ndarray) -> tuple:
    """The different tuples of words with the sums of their counts and, if given, the least of their places."""
    order, starts = _order(words)
    sums = (add.reduceat(x[order], starts) if len(starts) else x[:0] for add, x in ((np.add, counts), *((np.minimum, p) for p in places)))
    return [w[order[starts]] for w in words], *sums


def _chained(words: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """An order of k-mers: those of one row and strand stand together, from the last to the first, and rows by the last one's first word.

    The last one of a row mostly begins with the minimizer, so rows of one minimizer follow one another.
    """
    order = np.argsort(places)
    row = places[order] >> PLACE_BITS
    ends = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(ends, prepend=-1)
    by = np.argsort(words[0][order[ends]], kind="stable")
    ends, size = ends[by], size[by]
    within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return order[np.repeat(ends, size) - within]


def _merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of bytes with the sums of their counts."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(_U)
    order, starts = _order([np.ascontiguousarray(words[:, i]) for i in range(words.shape[1])])
    return rows[order[starts]], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _blobs(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive stretches of rows of bytes, each stretch column by column: what is 0 stands together."""
    data = b"".join(rows[i:j].tobytes("F") for i, j in zip(ends[:-1], ends[1:]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * rows.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _unblobbed(blob: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint8).reshape(width, -1).T


def super_blobs(k: int, parts: int, homopolymer: bool = False):
    """For mapInArrow over one column of sequences: (part, rows, counts), what a task holds for each part as two binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, size, held, bytes_held = [], 0, [], 0
        gap = np.full(1, 4, np.uint8)

        def taken() -> Iterator[pa.RecordBatch]:
            rows, of = np.concatenate([r for _, r in held]), np.concatenate([p for p, _ in held])
            held.clear()
            # The part follows from the row, so equal rows have one.
            tagged, counts = _merged(np.concatenate([of.astype("<i4").view(np.uint8).reshape(-1, 4), rows], axis=1), np.ones(len(rows), np.uint32))
            of = np.ascontiguousarray(tagged[:, :4]).view("<i4").ravel()
            # Rows of as many k-mers end in as many zeros.
            order = np.lexsort([~tagged[:, 4], of])
            of, rows, counts = of[order], tagged[order, 4:], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            ends = np.append(starts, len(of))
            yield pa.RecordBatch.from_arrays([pa.array(of[starts], pa.int32()), _blobs(rows, ends), _blobs(counts.astype("<u4").view(np.uint8).reshape(-1, 4), ends)], names=["part", "rows", "counts"])

        for batch in batches:
            for _, _, x in segments(batch.column(0), k, homopolymer):
                # Short sequences are read together, with a break between them.
                small += [x, gap]
                size += len(x) + 1
                if size >= SEGMENT:
                    held.append(super_rows(np.concatenate(small), k, parts))
                    bytes_held += held[-1][1].size
                    small, size = [], 0
                    if bytes_held >= HELD_BYTES:
                        yield from taken()
                        bytes_held = 0
        if small:
            held.append(super_rows(np.concatenate(small), k, parts))
        if held:
            yield from taken()

    return run


def _kmers(rows: np.ndarray, counts: np.ndarray, k: int, canonical: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(words, counts, turned to the other strand?) of the k-mers of rows whose numbers of k-mers fall, a place of all rows at a time.

    A word holds WORD symbols, the last one what the others leave; both strands are carried along symbol by symbol.
    """
    n, many = len(rows), -(-k // WORD)
    rest = _U(2 * (k - WORD * (many - 1)))
    mask = _U((1 << int(rest)) - 1)
    columns, counts = np.ascontiguousarray(rows[:, 1:].T), counts.astype(np.int64)
    here = np.bincount(rows[:, 0], minlength=2)
    here = n - np.cumsum(here)  # rows of more than i k-mers
    forward, reverse = ([np.zeros(n, _U) for _ in range(many)] for _ in range(2))
    two = _U(2)
    for j in range(k + int(rows[0, 0]) - 1):
        left = n if j < k else int(here[j - k + 1])
        c = (columns[j >> 2, :left] >> (6 - 2 * (j & 3)) & 3).astype(_U)
        forward, reverse = [w[:left] for w in forward], [w[:left] for w in reverse]
        for i in range(many - 1):
            forward[i] = forward[i] << two | (forward[i + 1] >> (_U(62) if i + 2 < many else rest - two))
        forward[-1] = (forward[-1] << two | c) & mask
        if canonical:
            for i in reversed(range(many)):
                enters = reverse[i - 1] & _U(3) if i else c ^ _U(3)
                reverse[i] = reverse[i] >> two | enters << (_U(62) if i + 1 < many else rest - two)
        if j < k - 1:
            continue
        if not canonical:
            yield forward, counts[:left], np.zeros(left, bool)
        elif many == 1:
            yield [np.minimum(forward[0], reverse[0])], counts[:left], reverse[0] < forward[0]
        else:
            less, open_ = np.zeros(left, bool), np.ones(left, bool)
            for f, r in zip(forward, reverse):
                less |= open_ & (r < f)
                open_ &= f == r
            yield [np.where(less, r, f) for f, r in zip(forward, reverse)], counts[:left], less


def _texts(words: list[np.ndarray], k: int) -> pa.Array:
    """The k-mers of words as strings."""
    n, full = len(words[0]), WORD * (len(words) - 1)
    raw = np.empty((n, len(words)), ">u8")
    for i, w in enumerate(words):
        raw[:, i] = w
    text = _FOURS[raw.view(np.uint8)].view(np.uint8)
    if k < full + WORD:  # the last word is filled from its lower end
        text = np.concatenate([text[:, :full], text[:, text.shape[1] - (k - full) :]], axis=1)
    ends = np.arange(0, n * k + 1, k, dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), pa.py_buffer(text)])


def _lots(rows: np.ndarray, k: int, most: int) -> Iterator[np.ndarray]:
    """The rows in lots of at most `most` k-mers; those of one minimizer are in one lot, which holds nothing else if they have more."""
    n = rows[:, 0].astype(np.int64)
    if int(n.sum()) <= most:
        yield np.arange(len(rows))
        return
    low = []
    for at in range(0, len(rows), ROWS):
        raw = rows[at : at + ROWS, 1 : 1 + -(-k // 4)]
        first = np.stack([raw >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), -1)[:, :k]
        low.append(_lows(first.ravel(), k)[::k])
    order, starts = _order([np.concatenate(low)])
    ends, held, begin = np.append(starts[1:], len(rows)), 0, 0
    for start, end, size in zip(starts.tolist(), ends.tolist(), np.add.reduceat(n[order], starts).tolist()):
        if held and held + size > most:
            yield order[begin:start]
            held, begin = 0, start
        held += size
    yield order[begin:]


def counted_parts(k: int, canonical: bool):
    """For applyInArrow over the rows of a part: (packed, count) up to PACKED symbols, else (kmer, count); each k-mer once.

    A part's super-k-mers are held in their bytes. Their k-mers are held up to TURN_BYTES, in lots of whole minimizers. Those of a larger
    lot are counted in turns, each of which takes those of some hashes only and keeps the count of each different k-mer, in one byte
    mostly, where it first stands; they are then made once more, some rows at a time.
    """
    span, most = k - minimizer_size(k) + 1, TURN_BYTES // (8 * -(-k // WORD))

    def joined(found: list[tuple]) -> tuple:
        words, *others = zip(*found)
        return _summed([np.concatenate(w) for w in zip(*words)], *(np.concatenate(x) for x in others))

    def placed(rows: np.ndarray, counts: np.ndarray, begin: int, end: int) -> Iterator[tuple]:
        for at in range(begin, min(end, len(rows)), ROWS):
            to = min(at + ROWS, end)
            for place, (words, n, turned) in enumerate(_kmers(rows[at:to], counts[at:to], k, canonical)):
                # A row's other strand is a row of its own, and is read from its own start.
                row = np.arange(at, at + len(n)) + turned * len(rows)
                yield words, n, row << PLACE_BITS | np.where(turned, (1 << PLACE_BITS) - 1 - place, place)

    def slots(places: np.ndarray, size: int) -> np.ndarray:
        """Numbers of places without their strand, of a lot of `size` rows."""
        row, place = places >> PLACE_BITS, places & ((1 << PLACE_BITS) - 1)
        return np.where(row < size, row * span + place, (row - size) * span + (1 << PLACE_BITS) - 1 - place)

    def in_turns(rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        turns = -(-int(rows[:, 0].sum(dtype=np.int64)) // most)
        # 0 where another place has the k-mer, and the largest byte where its count is among the others.
        held, others, full = np.zeros(len(rows) * span, np.uint8), [], 255
        for turn in range(turns):
            found, size, least = [], 0, most
            for words, n, places in placed(rows, counts, 0, len(rows)):
                h = words[0]
                for w in words[1:]:
                    h = _mixed(h) + w
                mine = _mixed(h) % _U(turns) == turn
                found.append(([w[mine] for w in words], n[mine], places[mine]))
                size += len(found[-1][1])
                if size > 2 * least:
                    # Many are equal, or else the hashes are dealt unevenly.
                    found = [joined(found)]
                    size = len(found[0][1])
                    least = max(most, size)
            _, n, places = joined(found)
            del found
            at = slots(places, len(rows))
            held[at] = np.minimum(n, full)
            others.append((at[n >= full], n[n >= full]))
        at, many = (np.concatenate(x) for x in zip(*others))
        order = np.argsort(at)
        at, many = at[order], many[order]
        some = max(1, most // span)
        for begin in range(0, len(rows), some):
            found = []
            for words, _, places in placed(rows, counts, begin, begin + some):
                slot = slots(places, len(rows))
                mine = held[slot] > 0
                slot = slot[mine]
                n = held[slot].astype(np.int64)
                n[n == full] = many[np.searchsorted(at, slot[n == full])]
                found.append(([w[mine] for w in words], n, places[mine]))
            yield found

    def ordered(words: list[np.ndarray], n: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = _chained(words, places)
        words, n = [w[order] for w in words], n[order]
        for i in range(0, len(n), 1 << 16):
            part = [w[i : i + (1 << 16)] for w in words]
            out = binaries(part[0].view(np.int64)) if k <= PACKED else _texts(part, k)
            yield pa.RecordBatch.from_arrays([out, pa.array(n[i : i + (1 << 16)])], names=["packed" if k <= PACKED else "kmer", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = [], []
        for batch in batches:
            for r, c in zip(batch.column("rows"), batch.column("counts")):
                counts.append(np.ascontiguousarray(_unblobbed(c, 4)).view("<u4").ravel().astype(np.int64))
                rows.append(_unblobbed(r, row_size(k)))
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        if int(rows[:, 0].sum(dtype=np.int64)) > most:
            rows, counts = _merged(rows, counts)
        for lot in _lots(rows, k, most):
            lot = lot[np.argsort(-rows[lot, 0].astype(np.int16), kind="stable")]
            some, times = rows[lot], counts[lot]
            if int(some[:, 0].sum(dtype=np.int64)) <= most:
                yield from ordered(*joined(list(placed(some, times, 0, len(some)))))
            else:
                for found in in_turns(some, times):
                    words, n, places = zip(*found)
                    yield from ordered([np.concatenate(w) for w in zip(*words)], np.concatenate(n), np.concatenate(places))

    return run
