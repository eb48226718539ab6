"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are cut into pieces of at most `size` tokens. The histogram of piece lengths (at most `size` entries,
whatever the corpus) is packed on the driver: lengths longest first, each into the open pack that holds least and has
room, whole groups of equal packs at a time. The patterns found are joined back by the rank of a piece among those
of its length; ranks come from counts per (length, bucket), so no task sees all pieces of a length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune, written

#: White space of the tokenizer's pattern, with the rest of a chunk: no token crosses the front of white space.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: A string that the tokenizer file lists as special; chunks that hold it are left to the tokenizer itself.
SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ChunkIds(dict):
    """chunk -> its ids as little-endian 32-bit words, kept within a task and emptied when large."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str, most: int = 600_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, self.most = Tokenizer.from_file(tokenizer), most
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.slow.encode(chunk, add_special_tokens=False).ids if SPECIAL in chunk else self.fast.encode_ordinary(chunk)
        out = self[chunk] = np.array(ids, "<u4").tobytes()
        return out


def _cut(tokenizer: str, ranks: str, pattern: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ChunkIds(tokenizer, ranks, pattern)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b"".join(map(ids.__getitem__, CHUNK.findall(text.as_py() or ""))) + b"\0\0\0\0"
                n = len(data) // 4
                rows += [(key, a, min(size, n - a), zlib.crc32(data[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts every document, its ids and a final id 0, every `size` tokens: one row per piece."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_cut(tokenizer, ranks, pattern, size), _PIECES)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Shortest-pack-first: (how many packs, {length: times in each}), for piece lengths 1 to size."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [packs, {length: times}]
    done: list[tuple[int, dict[int, int]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, groups in open_packs.items() if groups and r >= length), default=None)
            if room is None:
                count, held, room = left, {}, size
            else:
                count, held = open_packs[room].pop()
                if count > left:
                    open_packs[room].append([count - left, held])
                    count = left
            left -= count
            now = {**held, length: held.get(length, 0) + 1}
            if room == length:
                done.append((count, now))
            else:
                open_packs[room - length].append([count, now])
    return done + [(count, held) for groups in open_packs.values() for count, held in groups]


def slots(packs: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset, times): which ranks of a length a pattern takes, and where."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, held in packs:
        offset = 0
        for length, times in sorted(held.items(), reverse=True):
            out.append((length, taken[length], taken[length] + count * times, sequence, offset, times))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of a document, with the final id 0, lies in exactly one piece. Null and empty texts hold the final id only. Rows with
    null or repeated ids are packed like any other; equal rows may change places. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(pieces(docs, tokenizer, ranks, pattern, size, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    counts = written(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # At most `size` rows: one per length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # At most a few patterns per length, each with under sqrt(2 * size) different lengths: bounded by `size` alone.
    where = spark.createDataFrame(slots(patterns(histogram, size)), "length long, rank_from long, rank_to long, first long, slot long, times long")
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("place", F.row_number().over(place) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    put = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return put.select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        (F.col("first") + F.expr("(rank - rank_from) div times")).cast("long").alias("sequence_id"),
        (F.col("slot") + (nth % F.col("times")) * ranked["length"]).cast("long").alias("offset"),
    )
