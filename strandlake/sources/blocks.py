"""Text sequence files read block by block: every block finds its own records, and only what crosses a border is exchanged.

Lines come in the order of their file's blocks (the splits of Spark's text source); a line belongs to the block it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Symbols of a piece of a sequence, without those it shares with the next one.
PIECE = 1 << 20
#: Rows of a batch of pieces at most.
ROWS = 4096
_FASTA = "file string, block long, no long, at long, seq string"
_BORDER = "file string, block long, headers long, head string, head_len long, tail string, tail_len long"
_STITCHED = "file string, block long, first_record long, first_at long, border string, border_record long, border_at long"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = spark.read.text(paths if isinstance(paths, list) else [paths])
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, block), lines) of adjacent rows of one block; a block may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, file, block = (batch.column(i) for i in range(3))
        changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield (file[a].as_py(), block[a].as_py()), lines[a:b].cast(pa.string())


def _start(lines: pa.Array) -> int | None:
    """The first line that opens a record: one with @ whose second next begins with +; a quality line with @ has bases there."""
    text = lines[:6].to_pylist()
    return next((p for p in range(4) if text[p].startswith("@") and text[p + 2].startswith("+")), None)


def _fastq(edges: bool):
    """For mapInArrow over lines: the records that lie in one block, or the lines of those that do not, with their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rest, known, lost, at = None, pa.array([], pa.string()), False, False, 0

        def fragments(lines: pa.Array) -> list[pa.RecordBatch]:
            nonlocal at
            n, first = len(lines), at
            at += n
            if not edges or not n:
                return []
            same = [pa.array([x] * n, t) for x, t in zip(here, (pa.string(), pa.int64()))]
            return [pa.RecordBatch.from_arrays([*same, pa.array(range(first, first + n), pa.int64()), lines], names=["file", "block", "at", "line"])]

        for place, lines in _by_block(batches):
            if place != here:
                yield from fragments(rest)
                # A file begins with a record.
                here, rest, known, lost, at = place, lines[:0], place[1] == 0, False, 0
            rest = pa.concat_arrays([rest, lines])
            if not known and not lost and len(rest) >= 6:
                start = _start(rest)
                known, lost = start is not None, start is None
                if known:
                    yield from fragments(rest[:start])
                    rest = rest[start:]
            if lost:
                yield from fragments(rest)
                rest = rest[:0]
            if known:
                whole = len(rest) // 4 * 4
                if whole and not edges:
                    parts = [rest.take(pa.array(np.arange(i, whole, 4))) for i in range(4)]
                    yield pa.RecordBatch.from_arrays([*parts, pa.array([here[0]] * (whole // 4), pa.string())], names=["header", "seq", "plus", "qual", "file"])
                rest, at = rest[whole:], at + whole
        yield from fragments(rest)

    return run


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, seq, qual) of four-line FASTQ. Plain files are read in splits, without an exchange of records.

    A block finds its first record by its first six lines. Up to three lines before that and after the last whole record (all
    lines of a block of fewer than six) are exchanged; put in order within a file, every four of them are a record. Empty lines at the
    end of a file are no record. A record whose first or third line does not begin with @ or +, or whose sequence and quality
    differ in length, is an error when it is read.
    """
    lines = _lines(spark, paths)
    names = ["header", "seq", "plus", "qual"]
    whole = lines.mapInArrow(_fastq(False), f"{', '.join(f'{c} string' for c in names)}, file string")
    edges = lines.mapInArrow(_fastq(True), "file string, block long, at long, line string")
    no = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1
    part = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("line")))
    crossing = edges.withColumn("no", no).groupBy("file", F.floor(F.col("no") / 4).alias("record")).agg(*(part(i).alias(c) for i, c in enumerate(names)))
    records = whole.unionByName(crossing.select(*names, "file")).where(F.concat_ws("", *names) != "")
    right = F.col("header").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    wrong = F.raise_error(F.concat(F.lit("malformed FASTQ record "), F.coalesce("header", F.lit("")), F.lit(" of "), "file")).cast("string")
    return records.select(F.when(F.coalesce(right, F.lit(False)), F.substr("header", F.lit(2))).otherwise(wrong).alias("header"), "seq", "qual")


class _Open:
    """The part of a record that lies in the block being read: its number there, its length, its first and last symbols, its rest."""

    def __init__(self, no: int):
        self.no, self.length, self.head, self.tail, self.at, self.rest = no, 0, b"", b"", 0, bytearray()

    def add(self, data: bytes, shared: int) -> None:
        self.length += len(data)
        if len(self.head) < shared:
            self.head += data[: shared - len(self.head)]
        self.tail = (self.tail + data[-shared:])[-shared:] if shared else b""


def _fasta(k: int, size: int, borders: bool):
    """For mapInArrow over lines: the pieces of a block's sequences, or a row for each block of what its borders need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, first, headers = None, None, None, 0
        held, size_held = [], 0

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal size_held
            if held and (size_held >= least or len(held) >= ROWS):
                yield pa.RecordBatch.from_pylist(held)
                held.clear()
                size_held = 0

        def taken(last: bool) -> None:
            nonlocal size_held
            done = 0
            while len(now.rest) - done >= size + k - 1 or (last and len(now.rest) - done >= k):
                seq = bytes(now.rest[done : done + size + k - 1]).decode()
                held.append({"file": here[0], "block": here[1], "no": now.no, "at": now.at, "seq": seq})
                size_held += len(seq)
                done += size
                now.at += size
            del now.rest[:done]

        def closed() -> None:
            if not borders:
                return taken(True)
            head, length = (now.head, now.length) if first is None else first
            held.append({"file": here[0], "block": here[1], "headers": headers, "head": head.decode(), "head_len": length, "tail": now.tail.decode(), "tail_len": now.length})

        for place, lines in _by_block(batches):
            if place != here:
                if here is not None:
                    closed()
                here, now, first, headers = place, _Open(0), None, 0
            at = 0
            # Offsets and bytes of the lines: those between two headers are one slice.
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
            data = memoryview(lines.buffers()[2] or b"")
            for stop in [*np.flatnonzero(pc.starts_with(lines, ">").to_numpy(zero_copy_only=False)).tolist(), len(lines)]:
                text = bytes(data[ends[at] : ends[stop]])
                now.add(text, k - 1)
                if not borders:
                    now.rest += text
                    taken(stop < len(lines))
                if stop < len(lines):
                    first = (now.head, now.length) if first is None else first
                    headers += 1
                    now = _Open(headers)
                at = stop + 1
                yield from flushed(PIECE)
        if here is not None:
            closed()
        yield from flushed(0)

    return run


def _stitch(k: int):
    """For mapInArrow over the border rows of files, in order: where a block's first record stands, and the piece over its border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records, carry, length = None, 0, "", 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, records, carry, length = row["file"], 0, "", 0
                if not records and row["head_len"]:
                    raise ValueError(f"FASTA must begin with >: {file}")
                piece = carry + row["head"]
                spans = carry and row["head"] and len(piece) >= k
                out.append({
                    "file": file, "block": row["block"], "first_record": records - 1, "first_at": length,
                    "border": piece if spans else None, "border_record": records - 1, "border_at": length - len(carry),
                })
                if row["headers"]:
                    carry, length = row["tail"], row["tail_len"]
                else:
                    carry, length = (carry + row["tail"])[-(k - 1) :] if k > 1 else "", length + row["tail_len"]
                records += row["headers"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["file", "block", "first_record", "first_at", "border", "border_record", "border_at"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(names, kinds))))

    return run


def read_fasta_pieces(spark: SparkSession, paths: str | list[str], k: int, size: int = PIECE, placed: bool = True) -> DataFrame:
    """(file, record, at, seq): the sequences of FASTA in pieces that many tasks read; without `placed`, (seq) only.

    record is the sequence's number in its file, from 0, and at the place of the piece's first symbol. Every window of k symbols of a
    sequence lies in exactly one piece: pieces share k - 1 symbols with the next one, and a piece of at most 2k - 2 symbols spans each
    border of two blocks. So k-mers of pieces are those of whole sequences, with their places; homopolymers across pieces are
    not collapsed. Sequences shorter than k have no piece. A file with symbols before its first header is an error. One row for each
    block is exchanged; `placed` joins it back.
    """
    lines = _lines(spark, paths)
    inner = lines.mapInArrow(_fasta(k, size, False), _FASTA)
    ends = lines.mapInArrow(_fasta(k, size, True), _BORDER).repartition("file").sortWithinPartitions("file", "block")
    blocks = ends.mapInArrow(_stitch(k), _STITCHED)
    over = blocks.where("border is not null")
    if not placed:
        return inner.select("seq").unionByName(over.select(F.col("border").alias("seq")))
    at = F.col("at") + F.when(F.col("no") == 0, F.col("first_at")).otherwise(F.lit(0))
    inside = inner.join(blocks.select("file", "block", "first_record", "first_at"), ["file", "block"])
    inside = inside.select("file", (F.col("first_record") + F.col("no")).alias("record"), at.alias("at"), "seq")
    return inside.unionByName(over.select("file", F.col("border_record").alias("record"), F.col("border_at").alias("at"), F.col("border").alias("seq")))
