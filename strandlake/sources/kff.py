"""K-mer tables in KFF, the open interchange format of k-mer sets.

A table is written as a folder of whole KFF files, one for each task, in the order of the k-mers. Reading finds the sections of
each file by its index and deals them out in pieces.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import functions as K
from ..operators.table import KmerMeta, KmerTable
from .bam import filesystem

# Fixed values of the format: marker, version, order of the symbols by code.
MARKER, VERSION, ENCODING = b"KFF", (1, 0), 0b00_01_10_11
FOOTER = b"footer_size\0"
FIRST_INDEX = "first_index"

#: Records of a section that is written, bytes of a piece that is read, and records of one batch.
SECTION, PIECE, BATCH = 1 << 20, 1 << 26, 1 << 17


def _number(file, size: int, signed: bool = False) -> int:
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the file ends too early")
    return int.from_bytes(data, "big", signed=signed)


def _variables(file) -> dict[str, int]:
    """The variables of a section, behind its type."""
    out = {}
    for _ in range(_number(file, 8)):
        name = bytearray()
        while (c := _number(file, 1)) != 0:
            name.append(c)
        out[name.decode("ascii")] = _number(file, 8)
    return out


def _footer(file, length: int) -> dict[str, int]:
    """The variables of the footer; none where a file has no footer."""
    file.seek(max(0, length - 23))
    tail = file.read(23)
    if not tail.endswith(MARKER):
        raise ValueError("no KFF marker at the end")
    if not tail.startswith(FOOTER):
        return {}
    file.seek(length - 3 - int.from_bytes(tail[12:20], "big"))
    if file.read(1) != b"v":
        raise ValueError("the footer is no section of variables")
    return _variables(file)


def _index(file, first: int) -> list[tuple[bytes, int]]:
    """(type, place) of all sections that the chained indexes list, by place."""
    out, seen = [], set()
    while first:
        if first in seen:
            raise ValueError("the indexes run in a circle")
        seen.add(first)
        file.seek(first)
        if file.read(1) != b"i":
            raise ValueError("no index where one should be")
        n = _number(file, 8)
        end = first + 9 + 9 * n + 8
        for _ in range(n):
            kind = file.read(1)
            out.append((kind, end + _number(file, 8, signed=True)))
        first = _number(file, 8)
    return sorted(out, key=lambda x: x[1])


def _sections(file, length: int) -> tuple[dict[str, int], list[dict[str, int]]]:
    """What holds for a whole file, and its raw sections: place of the first block, number of blocks, variables in force."""
    file.seek(0)
    if file.read(3) != MARKER:
        raise ValueError("no KFF marker at the start")
    if _number(file, 1) != VERSION[0]:
        raise ValueError("unknown version of KFF")
    _number(file, 1)
    about = {"encoding": _number(file, 1), "unique": _number(file, 1), "canonical": _number(file, 1)}
    if not about["unique"]:
        raise ValueError("only files of unique k-mers can be read")
    if sorted(about["encoding"] >> s & 3 for s in (0, 2, 4, 6)) != [0, 1, 2, 3]:
        raise ValueError("two symbols have the same code")
    free = _number(file, 4)
    begin = file.tell() + free
    file.seek(begin)
    opens = file.read(1)
    footer = _footer(file, length)
    first = begin if opens == b"i" else footer.get(FIRST_INDEX)
    if not first or footer.get(FIRST_INDEX, first) != first:
        raise ValueError("no index, or two that differ")
    out, held = [], {}
    for kind, place in _index(file, first):
        file.seek(place)
        if file.read(1) != kind:
            raise ValueError("the index does not fit the sections")
        if kind == b"v":
            held = _variables(file)
        elif kind == b"r":
            if missing := {"k", "max", "data_size"} - held.keys():
                raise ValueError(f"a raw section lacks {sorted(missing)}")
            if held["data_size"] > 8 or not held["k"] or not held["max"]:
                raise ValueError("counters of more than 8 bytes, or no k-mers, cannot be read")
            n = _number(file, 8)
            out.append({"place": file.tell(), "blocks": n, "k": held["k"], "max": held["max"], "size": held["data_size"], "ordered": held.get("ordered", 0)})
        elif kind != b"i":
            raise ValueError(f"sections of type {kind!r} cannot be read")
    return about | footer, out


_PIECES = "path string, length long, place long, blocks long, k long, max long, size long, ordered long, encoding long, canonical boolean, low long, high long, counter_size long"


def _pieces(piece_bytes: int):
    """One row for each piece of a section; sections of blocks of several k-mers, whose sizes differ, are one piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in batch.itertuples(index=False):
                with _open(path) as file:
                    try:
                        about, sections = _sections(file, length)
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                rows = []
                for s in sections:
                    record = -(-s["k"] // 4) + s["size"]
                    step = max(1, piece_bytes // record) if s["max"] == 1 else max(1, s["blocks"])
                    high = min(about.get("max_count", (1 << 8 * s["size"]) - 1 or 1), (1 << 63) - 1)
                    same = (s["k"], s["max"], s["size"], s["ordered"], about["encoding"], bool(about["canonical"]))
                    limits = (about.get("min_count", 1), high, about.get("counter_size", s["size"]))
                    # The first piece of a section stands even where it is empty, for what it tells of the table.
                    for at in range(0, max(1, s["blocks"]), step):
                        rows.append((path, length, s["place"] + at * record, min(step, s["blocks"] - at), *same, *limits))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _open(path: str):
    system, name = filesystem(path)
    return system.open_input_file(name)


def _strings(data: np.ndarray, k: int, encoding: int) -> tuple[pa.Array, np.ndarray]:
    """K-mers, as strings and as rows of codes, of rows of bytes with four codes each, filled up on the left."""
    codes = np.stack([data >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(data), -1)[:, -k:]
    symbols = np.empty(4, np.uint8)
    for symbol, shift in zip(b"ACGT", (6, 4, 2, 0)):
        symbols[encoding >> shift & 3] = symbol
    text = pa.py_buffer(np.ascontiguousarray(symbols[codes]))
    ends = pa.py_buffer(np.arange(0, (len(data) + 1) * k, k, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(data), ends, text).cast(pa.string()), codes


def _counts(data: np.ndarray) -> np.ndarray:
    """Counters of rows of big-endian bytes; k-mers without counters count once."""
    if not data.shape[1]:
        return np.ones(len(data), np.int64)
    out = np.zeros(len(data), np.uint64)
    for i in range(data.shape[1]):
        out = out << np.uint64(8) | data[:, i]
    if len(out) and out.max() > np.uint64(2**63 - 1):
        raise ValueError("a counter is too large")
    return out.astype(np.int64)


def _single(file, place: int, blocks: int, k: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed k-mers, counters) of blocks of one k-mer each."""
    width = -(-k // 4)
    file.seek(place)
    for at in range(0, blocks, BATCH):
        n = min(BATCH, blocks - at)
        data = file.read(n * (width + size))
        if len(data) < n * (width + size):
            raise ValueError("the file ends inside a section")
        rows = np.frombuffer(data, np.uint8).reshape(n, width + size)
        yield rows[:, :width], _counts(rows[:, width:])


def _several(file, place: int, blocks: int, k: int, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed k-mers, counters) of blocks of overlapping k-mers: their number, the sequence, the counters."""
    width, head, held, n_held = -(-k // 4), (most.bit_length() + 7) // 8, [], 0
    file.seek(place)
    for b in range(blocks):
        n = _number(file, head)
        if n > most:
            raise ValueError("a block has too many k-mers")
        packed, data = file.read(-(-(n + k - 1) // 4)), file.read(n * size)
        if len(packed) < -(-(n + k - 1) // 4) or len(data) < n * size:
            raise ValueError("the file ends inside a section")
        bits = np.frombuffer(packed, np.uint8)
        codes = np.stack([bits >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel()[-(n + k - 1) :]
        if n:
            each = np.zeros((n, 4 * width), np.uint8)
            each[:, -k:] = np.lib.stride_tricks.sliding_window_view(codes, k)
            quads = each.reshape(n, width, 4)
            held.append((quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3], _counts(np.frombuffer(data, np.uint8).reshape(n, size))))
            n_held += n
        if held and (n_held >= BATCH or b == blocks - 1):
            yield np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])
            held, n_held = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            with _open(p["path"]) as file:
                args = file, p["place"], p["blocks"], p["k"], p["size"]
                last = None
                for rows, counts in _single(*args) if p["max"] == 1 else _several(*args, p["max"]):
                    strings, codes = _strings(rows, p["k"], p["encoding"])
                    if p["ordered"]:
                        whole = codes if last is None else np.vstack([last, codes])
                        # Differences of neighbours at their first differing symbol must be positive; k-mers are unique.
                        differ = whole[1:].astype(np.int8) - whole[:-1].astype(np.int8)
                        first = differ[np.arange(len(differ)), (differ != 0).argmax(axis=1)]
                        if (first <= 0).any():
                            raise ValueError(f"{p['path']}: the k-mers of an ordered section are not in order")
                        last = codes[-1:]
                    yield pa.RecordBatch.from_arrays([strings, pa.array(counts)], names=["kmer", "count"])


def read_kff(spark: SparkSession, paths: str | list[str], piece_bytes: int = PIECE) -> KmerTable:
    """The k-mers of KFF files, or of folders of such, as one table.

    All files must have the same k and strands. Files are read in pieces of sections, found by the files' indexes. Limits are the
    widest of the files'. A section of blocks of several k-mers is read by one task, as its blocks differ in size. Canonical k-mers
    are turned to the smaller strand in the order ACGT, whatever the files' order of symbols. K-mers without counters count once.
    An error when rows are read: a k-mer twice (also by its other strand), an ordered section that is not in order. Sections by
    minimizers and files of k-mers that are not unique are refused. The files' folder must be one that pyarrow reaches.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kff").load(paths).select("path", "length")
    pieces = files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(_pieces(piece_bytes), _PIECES)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("k", "canonical") for f in (F.min, F.max)]
    about = pieces.agg(*ends, F.min("low").alias("low"), F.max("high").alias("high"), F.max("counter_size").alias("counter_size"), F.count("*").alias("n")).first()
    if not about["n"]:
        raise ValueError("no KFF sections there")
    if about["min_k"] != about["max_k"] or about["min_canonical"] != about["max_canonical"]:
        raise ValueError("the files differ in k or in strands")
    rows = pieces.drop("canonical", "low", "high", "counter_size").repartition(int(about["n"])).mapInArrow(_decoded, "kmer string, count long")
    if about["min_canonical"]:
        rows = rows.withColumn("kmer", K.canonical(F.col("kmer")))
    each = rows.groupBy("kmer").agg(F.sum("count").alias("count"), F.count("*").alias("n"))
    once = F.when(F.col("n") == 1, F.col("count")).otherwise(F.raise_error(F.concat(F.lit("a k-mer stands twice: "), "kmer")).cast("long"))
    meta = KmerMeta(int(about["min_k"]), bool(about["min_canonical"]), int(about["low"]), int(about["high"]), int(about["counter_size"]))
    return KmerTable(each.select("kmer", once.alias("count")), meta)


@dataclass
class _Part(WriterCommitMessage):
    name: str


def _section(values: dict[str, int]) -> bytes:
    """A section of variables."""
    return b"v" + struct.pack(">Q", len(values)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", v) for n, v in values.items())


class _KffWriter(DataSourceArrowWriter):
    """Writes each task's rows, which come in order, as a file of its own under a name that no other attempt has; commit renames."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.k, self.size = int(options["k"]), int(options["counter_size"])
        self.canonical, self.overwrite = options["canonical"] == "true", overwrite
        self.limits = {"min_count": int(options["min_count"]), "max_count": int(options["max_count"])}
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}-{uuid.uuid4().hex[:8]}.kff"
        system, folder = filesystem(self.folder)
        system.create_dir(f"{folder}/_pending-{self.run}", recursive=True)
        with system.open_output_stream(f"{folder}/_pending-{self.run}/{name}") as out:
            self._file(out, iterator)
        return _Part(name)

    def _file(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        head = MARKER + bytes([*VERSION, ENCODING, 1, self.canonical]) + struct.pack(">I", 0)
        variables = _section({"k": self.k, "max": 1, "data_size": self.size, "ordered": 1})
        out.write(head + variables)
        places, at, held, n_held = [(b"v", len(head))], len(head) + len(variables), [], 0

        def section() -> None:
            nonlocal at, held, n_held
            data = b"r" + struct.pack(">Q", n_held) + b"".join(held)
            places.append((b"r", at))
            out.write(data)
            at, held, n_held = at + len(data), [], 0

        for batch in batches:
            held.append(self._packed(batch))
            n_held += batch.num_rows
            if n_held >= SECTION:
                section()
        if n_held or len(places) == 1:
            section()
        end = at + 1 + 8 + 9 * (len(places) + 1) + 8
        # The footer is the last section, at the index's end.
        listed = b"".join(kind + struct.pack(">q", place - end) for kind, place in [*places, (b"v", end)])
        footer = {FIRST_INDEX: at, **self.limits, "counter_size": self.size, "footer_size": 0}
        footer["footer_size"] = len(_section(footer))
        out.write(b"i" + struct.pack(">Q", len(places) + 1) + listed + struct.pack(">Q", 0) + _section(footer) + MARKER)

    def _packed(self, batch: pa.RecordBatch) -> bytes:
        kmers, counts = batch.column("kmer"), batch.column("count").to_numpy(zero_copy_only=False).astype(np.uint64)
        n, width = batch.num_rows, -(-self.k // 4)
        text = "".join(kmers.to_pylist()).encode()
        if kmers.null_count or len(text) != n * self.k or (self.size < 8 and n and int(counts.max()) >> 8 * self.size):
            raise ValueError("k-mers of another length, or counters beyond the counter's size")
        table = np.full(256, 4, np.uint8)
        table[list(b"ACGT")] = np.arange(4)
        codes = np.zeros((n, 4 * width), np.uint8)
        codes[:, 4 * width - self.k :] = table[np.frombuffer(text, np.uint8)].reshape(n, self.k)
        if (codes > 3).any():
            raise ValueError("k-mers have other symbols than ACGT")
        quads = codes.reshape(n, width, 4)
        rows = np.empty((n, width + self.size), np.uint8)
        rows[:, :width] = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
        for i in range(self.size):
            rows[:, width + i] = (counts >> np.uint64(8 * (self.size - 1 - i))) & np.uint64(255)
        return rows.tobytes()

    def commit(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        system, folder = filesystem(self.folder)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".kff")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(f"{folder}/_pending-{self.run}/{m.name}", f"{folder}/{m.name}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        system, folder = filesystem(self.folder)
        if system.get_file_info(f"{folder}/_pending-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_pending-{self.run}")


class _KffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kff"

    def schema(self) -> str:
        return "kmer string, count long"

    def writer(self, schema, overwrite: bool) -> _KffWriter:
        return _KffWriter(dict(self.options), overwrite)


def write_kff(table: KmerTable, path: str, files: int | None = None) -> None:
    """Writes the rows within the table's cutoffs as a folder of KFF files, in place of those there.

    The files are ordered and follow one another in the order of the k-mers; with `files=1` there is one, made by one task. Tasks
    write files under names of their own, which the driver moves into place when all are done, so that repeated tasks leave none.
    """
    meta = table.meta
    spark = table.df.sparkSession
    spark.dataSource.register(_KffSource)
    rows = table.cut().select("kmer", F.col("count").cast("long").alias("count"))
    ranged = rows.repartitionByRange(files, "kmer") if files else rows.repartitionByRange("kmer")
    size = max(1, min(8, meta.counter_size))
    options = {"k": meta.k, "canonical": meta.canonical, "min_count": meta.min_count, "max_count": meta.max_count, "counter_size": size}
    ranged.sortWithinPartitions("kmer").write.format("kff").options(**options).mode("overwrite").save(path)
