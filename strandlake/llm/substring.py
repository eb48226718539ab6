"""Substring dedup: passages that repeat across documents, found level by level.

The levels are the wanted length halved until it is short, then doubled back: 13, 25 and 50 words for 50. At a level, each window
of full length is stood for by the one window of the level inside it that has the smallest hash (the same choice wherever the
passage occurs), so a few percent of all windows are counted. Those that occur in one document only fall out, and with them
the windows of full length that they stood for; the others are extended to the next level, until the full length is
reached. With `longest_repeats`, doubling goes on from there until no window survives. Windows of full length are compared by
128 bits, those of the levels before by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tune, written
from .words import HashCache, digest128, hashes, joined, lists, mix, signed, texts, windows

_SCAN = "doc_id long, text_hash long, n_words long, seq_lo long, seq_hi long, anchors array<long>"
_ANCHORS = "doc_id long, text_hash long, anchors array<long>"
_LEVEL = "doc_id long, text_hash long, starts array<int>, keys array<long>, checks array<long>"
#: The shortest level has more than half of this many words, or is the wanted length itself; rows of one window are dealt to SALTS parts.
SHORTEST, SALTS = 25, 64
_ROW = ["doc_id", "text_hash"]


def levels(size: int) -> list[int]:
    """Lengths from short to `size`, each at least half of the next."""
    out = [size]
    while out[0] >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _other(h: np.ndarray) -> np.ndarray:
    """Word hashes from which windows get hashes of their own, independent of the first ones."""
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each run of `span` adjacent values."""
    n, width, low = len(x) - span + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[span - width : span - width + n])


def _scan(size: int, level: int):
    span = size - level + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            rows = []
            for text in texts(batch.column(2)):
                words = (text or b"").split()
                anchors = np.zeros(0, np.int64)
                if len(words) >= size:
                    w = windows(hashes(words, cache), level)
                    anchors = signed(np.unique(_least(w, span)))
                rows.append((len(words), *digest128(words), anchors))
            n, lo, hi, anchors = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), lists(list(anchors), pa.int64())],
                names=[*_ROW, "n_words", "seq_lo", "seq_hi", "anchors"],
            )

    return run


def _standing(h: np.ndarray, size: int, level: int, live: np.ndarray) -> np.ndarray:
    """Which windows of `size` words are stood for by a live window of `level` words."""
    return np.isin(_least(windows(h, level), size - level + 1), live)


def _extend(size: int, steps: list[int], last: bool):
    """The next level's windows, or those of full length, of the windows that all levels so far leave.

    steps are the levels so far and the next one; column 3 on hold the live windows of the levels so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            starts, keys, checks = [], [], []
            for k, text in enumerate(texts(batch.column(2))):
                h = hashes(text.split(), cache)
                ok = np.ones(max(0, len(h) - size + 1), bool)
                for level, live in zip(steps, batch.columns[3:]):
                    ok &= _standing(h, size, level, np.asarray(live[k].values).view(np.uint64))
                at = np.flatnonzero(ok)
                if last:
                    keys.append(signed(windows(h, size)[at]))
                    checks.append(signed(windows(_other(h), size)[at]))
                    starts.append(at.astype(np.int32))
                else:
                    keys.append(signed(np.unique(_least(windows(h, steps[-1]), size - steps[-1] + 1)[at])))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(starts, pa.int32()), lists(keys, pa.int64()), lists(checks, pa.int64())], names=[*_ROW, "starts", "keys", "checks"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(keys, pa.int64())], names=[*_ROW, "anchors"])

    return run


def _double(size: int):
    """Windows of `size` whose two halves both survived the level before."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, keys, checks = [], [], []
            for at, key, check in zip(*(batch.column(i) for i in (2, 3, 4))):
                at, key, check = np.asarray(at.values), np.asarray(key.values).view(np.uint64), np.asarray(check.values).view(np.uint64)
                order = np.argsort(at)
                at, key, check = at[order], key[order], check[order]
                there = np.searchsorted(at, at + half)
                ok = (there < len(at)) & (at[np.minimum(there, len(at) - 1)] == at + half)
                keys.append(signed(joined(key[ok], key[there[ok]])))
                checks.append(signed(joined(check[ok], check[there[ok]])))
                starts.append(at[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(starts, pa.int32()), lists(keys, pa.int64()), lists(checks, pa.int64())], names=[*_ROW, "starts", "keys", "checks"])

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, starts, copy in zip(texts(batch.column(1)), batch.column(2), batch.column(3).to_pylist()):
                words = (text or b"").split()
                n.append(len(words))
                if copy and len(words) >= size:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.asarray(starts.values)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))


def _held_twice(flat: DataFrame, by: list[str]) -> DataFrame:
    """flat (a row, `by`, more) with `least`, the smallest id, for the values of `by` that two documents have.

    The rows of one value are dealt to SALTS parts, so a value that many documents share is no single task's work.
    """
    dealt = flat.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = dealt.groupBy(*by, "salt").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    least = parts.groupBy(*by).agg(F.min("a").alias("least"), F.max("b").alias("most"), F.collect_set("salt").alias("salts")).where("least < most")
    return dealt.join(least.select(*by, "least", F.explode("salts").alias("salt")), [*by, "salt"]).drop("salt")


def _leads(src: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan, copies, level): the scanned rows, those whose word sequence has a smaller id, and the windows of
    `size` words of all others that hold, at each level below, a window found in two documents."""
    steps = levels(size)
    scan = written(src.mapInArrow(_scan(size, steps[0]), _SCAN), "scan")
    known = scan.where("doc_id is not null")
    ranked = _held_twice(known.where(F.col("n_words") >= size).select(*_ROW, "seq_lo", "seq_hi"), ["seq_lo", "seq_hi"])
    copies = written(ranked.where("doc_id > least").select(*_ROW).distinct(), "copies")
    own = known.where("size(anchors) > 0").select(*_ROW, "anchors").join(copies, _ROW, "left_anti")
    live: list[str] = []
    text, used = src, []
    for k, length in enumerate(steps[:-1]):
        each = _held_twice(own.select(*_ROW, F.explode("anchors").alias("key")), ["key"])
        live.append(f"live{length}")
        part = text.join(each.groupBy(*_ROW).agg(F.collect_set("key").alias(live[-1])), _ROW)
        # The texts that are left go on to the next level with the live windows of this one.
        text = written(part.dropDuplicates(_ROW) if k == 0 else part, "extended")
        last = k + 2 == len(steps)
        own = text.select(*_ROW, "text", *live).mapInArrow(_extend(size, steps[: k + 2], last), _LEVEL if last else _ANCHORS)
        own = written(own.where("size(starts) > 0" if last else "size(anchors) > 0"), "level")
        used += [text] if last else [text, own]
    for x in used:
        discard(x)
    if len(steps) == 1:
        own = src.where("text is not null and doc_id is not null").join(copies, _ROW, "left_anti").dropDuplicates(_ROW)
        own = written(own.mapInArrow(_extend(size, steps, True), _LEVEL).where("size(starts) > 0"), "level")
    return scan, copies, own


def _shared(level: DataFrame) -> DataFrame:
    """The windows of a level that start in two documents: row, start, key, check, least (the smallest such id)."""
    pair = F.explode(F.arrays_zip("starts", "keys", "checks")).alias("x")
    flat = level.select(*_ROW, pair).select(*_ROW, F.col("x.starts").alias("start"), F.col("x.keys").alias("key"), F.col("x.checks").alias("check"))
    return _held_twice(flat, ["key", "check"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes when a window of `size` words that covers it also starts in a document with a smaller id. Windows
    are judged on the input. Null texts have no words. Rows with a null id neither lose words nor make others lose
    any; rows with the same id do not remove one another's words. Exact copies (the same word sequence) are settled
    by their digest; only the ones with the smallest id take part in the levels. Other columns of `docs`, whatever
    their names, are not read. An empty table gives an empty result.
    """
    if size < 2:
        raise ValueError("size must be at least 2")
    tune(docs.sparkSession)
    src = _source(docs, id_col, text_col)
    scan, copies, level = _leads(src, size)
    starts = _shared(level).where("doc_id > least").groupBy(*_ROW).agg(F.collect_list("start").alias("starts"))
    marks = written(starts.select(*_ROW, "starts", F.lit(False).alias("copy")).unionByName(copies.select(*_ROW, F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))), "marks")
    discard(scan)
    discard(level)
    return src.join(marks, _ROW, "left").select("doc_id", "text", "starts", "copy").mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept string")


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(doc_id, longest): the greatest length size * 2**i at which a window of the document repeats in another one.

    Goes on doubling until no window survives. Documents without such a window, and all copies of a word sequence
    but those with the smallest id, are not listed.
    """
    tune(docs.sparkSession)
    _, _, level = _leads(_source(docs, id_col, text_col), size)
    found, length = [], size
    while True:
        kept = written(_shared(level).groupBy(*_ROW).agg(*(F.collect_list(c).alias(f"{c}s") for c in ("start", "key", "check"))), "kept")
        if not kept.take(1):
            break
        found.append(kept.select("doc_id", F.lit(length).cast("long").alias("longest")))
        length *= 2
        level = written(kept.mapInArrow(_double(length), _LEVEL).where("size(starts) > 0"), "level")
    out = docs.sparkSession.createDataFrame([], "doc_id long, longest long")
    for x in found:
        out = out.unionByName(x)
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
