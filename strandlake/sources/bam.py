"""Reads of BAM files, in splits.

A BAM file is a chain of compressed blocks, its records a chain of their own that runs across them. A split begins at a
place where records look right; it holds only if the split before it ends just there. A split that does not hold begins where
the one before it ends instead, and only such splits are walked again, so a wrong guess costs time and no read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
BLOCK, HEAD, MAGIC = 1 << 16, b"\x1f\x8b\x08\x04", b"BAM\x01"
SYMBOLS, COMPLEMENTS = "=ACMGRSVTWYHKDBN", "=TGKCYSBAWRDMHVN"
REVERSE, SECONDARY, SUPPLEMENTARY = 0x10, 0x100, 0x800

#: Bytes read from a file at a time, bytes of records that a guess looks at first, and bases of one batch of reads.
CHUNK, GUESS, BATCH = 1 << 22, 1 << 18, 1 << 22

_BASES = str.maketrans("0123456789abcdef", SYMBOLS)
_OTHER = str.maketrans(SYMBOLS, COMPLEMENTS)
_QUALITY = bytes(min(126, q + 33) for q in range(256))


def filesystem(path: str) -> tuple:
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _open(path: str):
    system, name = filesystem(path)
    return system.open_input_file(name)


def _inflated(held: bytes, i: int) -> tuple[int, bytes]:
    """Size and content of the block at place i; ValueError if there is none."""
    try:
        if held[i : i + 4] != HEAD:
            raise ValueError("no block")
        extra, size, at = struct.unpack_from("<H", held, i + 10)[0], 0, i + 12
        while at < i + 12 + extra:
            tag, n = held[at : at + 2], struct.unpack_from("<H", held, at + 2)[0]
            size = struct.unpack_from("<H", held, at + 4)[0] + 1 if tag == b"BC" and n == 2 else size
            at += 4 + n
        crc, length = struct.unpack_from("<II", held, i + size - 8)
        data = zlib.decompress(held[at : i + size - 8], -15)
        if not size or len(data) != length or zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        return size, data
    except (struct.error, zlib.error) as e:
        raise ValueError("damaged block") from e


def _blocks(file, length: int, start: int, seek: bool = False) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from start on; with `seek`, from the first one at or after it."""
    base, held, at = start, b"", start
    while at < length:
        if base + len(held) < min(length, at + 2 * BLOCK):
            held, base = held[at - base :], at
            file.seek(base + len(held))
            held += file.read(CHUNK)
        if seek:
            for i in range(min(BLOCK, len(held))):
                if held.startswith(HEAD, i):
                    try:
                        _inflated(held, i)
                    except ValueError:
                        continue
                    at, seek = base + i, False
                    break
            if seek:
                return
        size, data = _inflated(held, at - base)
        yield at, data
        at += size


def _after_header(buf: bytes) -> int | None:
    """Where the records begin; None if the header goes on beyond buf."""
    if len(buf) >= 4 and not buf.startswith(MAGIC):
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", buf, 4)[0]
        refs, at = struct.unpack_from("<i", buf, at)[0], at + 4
        for _ in range(refs):
            at += 8 + struct.unpack_from("<i", buf, at)[0]
    except struct.error:
        return None
    return at if at <= len(buf) else None


def _plausible(buf: bytes, at: int) -> bool:
    """Whether records follow one another from here to the end of buf."""
    while at + 36 <= len(buf):
        size, ref, pos, name, _, _, cigar, _, n, mate, there = struct.unpack_from("<iiiBBHHHiii", buf, at)
        if ref < -1 or pos < -1 or mate < -1 or there < -1 or n < 0 or not name or 32 + name + 4 * cigar + (n + 1) // 2 + n > size:
            return False
        end = at + 36 + name
        if end <= len(buf) and buf.find(0, at + 36, end) != end - 1:
            return False
        at += 4 + size
    return True


def _virtual(marks: list[tuple[int, int]], pos: int) -> int:
    """Place of the block and place in it, as one number, of the byte at pos; marks holds (pos, place) of the blocks."""
    at, place = max(m for m in marks if m[0] <= pos)
    return place << 16 | (pos - at)


def _first(file, length: int, start: int, end: int) -> int | None:
    """Where the records of a split seem to begin; None if none does."""
    buf, marks, tried, size = b"", [], 0, GUESS
    for place, data in _blocks(file, length, start, start > 0):
        if start and place >= end and len(buf) - tried < 36:
            return None
        marks.append((len(buf), place))
        buf += data
        if not start:
            at = _after_header(buf)
            if at is not None and at < len(buf):
                return _virtual(marks, at)
        elif len(buf) >= size or place >= end:
            for at in range(tried, len(buf) - 35):
                if _plausible(buf, at):
                    found = _virtual(marks, at)
                    return found if found >> 16 < end else None
            tried, size = max(0, len(buf) - 35), 2 * size
    if not start:
        if _after_header(buf) is None:
            raise ValueError("the file ends inside its header")
        return None
    return next((_virtual(marks, at) for at in range(tried, len(buf) - 35) if _plausible(buf, at)), None)


def _records(file, length: int, first: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(place, record) from `first` to the last one that begins in a block before `end`, then (place, None) of the next one if any."""
    buf, pos, marks = b"", first & 0xFFFF, []
    for place, data in _blocks(file, length, first >> 16):
        marks.append((len(buf), place))
        buf += data
        while pos + 4 <= len(buf):
            if marks[-1][0] <= pos:
                del marks[:-1]
            size = struct.unpack_from("<i", buf, pos)[0]
            if size < 32:
                raise ValueError("damaged record")
            if (at := _virtual(marks, pos)) >> 16 >= end:
                yield at, None
                return
            if pos + 4 + size > len(buf):
                break
            yield at, buf[pos + 4 : pos + 4 + size]
            pos += 4 + size
        buf, marks, pos = buf[pos:], [(a - pos, p) for a, p in marks], 0 if pos <= len(buf) else pos - len(buf)
    if buf:
        raise ValueError("the file ends inside a record")


#: Marks in place of a place, as numbers so that pandas keeps all places whole: no record; no chain of records.
NONE, BROKEN = -1, -2


def _end(path: str, length: int, first: int, end: int) -> int:
    """Where the record after the last one of a split that begins at `first` is, or a mark."""
    after = NONE
    with _open(path) as file:
        try:
            for at, record in _records(file, length, first, end):
                after = at if record is None else NONE
        except ValueError:
            return BROKEN  # a wrong guess; a damaged file raises when its records are read
    return after


_MARKS = {"path": "string", "length": "long", "start": "long", "end": "long", "first": "long", "after": "long"}


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, length, start, end in batch.itertuples(index=False):
            with _open(path) as file:
                first = _first(file, length, start, end)
            mark = (NONE, NONE) if first is None else (first, _end(path, length, first, end))
            yield pd.DataFrame([(path, length, start, end, *mark)], columns=list(_MARKS))


def _mended(marks: pd.DataFrame) -> pd.DataFrame:
    """(path, length, first, end) of one file's splits that hold records, each beginning where the one before it ends.

    A split that begins elsewhere is walked again from there; the next one that begins right is taken as it is.
    """
    out, there = [], NONE
    for path, length, start, end, first, after in marks.sort_values("start").itertuples(index=False):
        if start:
            if there == NONE or there >> 16 >= end:
                continue
            if first != there:
                first, after = there, _end(path, length, there, end)
        if first == NONE:
            break
        out.append((path, length, first, end))
        if after == BROKEN:
            break  # damaged; reading this split raises
        there = after
    return pd.DataFrame(out, columns=["path", "length", "first", "end"])


def _decoded(forward: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, first, end in batch.itertuples(index=False):
                rows, bases = [], 0
                with _open(path) as file:
                    for _, record in _records(file, length, first, end):
                        if record is None:
                            break
                        name, _, _, cigar, flag, n = struct.unpack_from("<BBHHHi", record, 8)
                        if flag & (SECONDARY | SUPPLEMENTARY):
                            continue
                        at = 32 + name + 4 * cigar
                        seq, quality = record[at : at + (n + 1) // 2].hex().translate(_BASES)[:n], record[at + (n + 1) // 2 :][:n]
                        qual = None if quality[:1] in (b"\xff", b"") else quality.translate(_QUALITY).decode("ascii")
                        if forward and flag & REVERSE:
                            seq, qual = seq.translate(_OTHER)[::-1], qual and qual[::-1]
                        rows.append((record[32 : 31 + name].decode("latin-1"), seq, qual))
                        bases += n
                        if bases >= BATCH or len(rows) >= BATCH >> 8:
                            yield pd.DataFrame(rows, columns=["header", "seq", "qual"])
                            rows, bases = [], 0
                yield pd.DataFrame(rows, columns=["header", "seq", "qual"])

    return run


def read_bam(spark: SparkSession, paths: str | list[str], forward: bool = False, split_bytes: int = 1 << 26) -> DataFrame:
    """(header, seq, qual) of the primary records of BAM files; qual is null where a file has none.

    Secondary and supplementary records are left out. `forward` turns reads that are stored as their reverse complement back, for
    strand-specific counting. Damaged files raise an error. One row for each split is exchanged. The files' folder must be one that pyarrow reaches.
    """
    if split_bytes < BLOCK:
        raise ValueError(f"a split must have at least {BLOCK} bytes")
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = files.select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "length"))
    n = max(1, splits.count())
    marks = splits.repartition(n).mapInPandas(_splits, ", ".join(f"{c} {t}" for c, t in _MARKS.items()))
    held = marks.groupBy("path").applyInPandas(_mended, "path string, length long, first long, end long").repartition(n)
    return held.mapInPandas(_decoded(forward), "header string, seq string, qual string")
