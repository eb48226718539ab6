"""Spelling variant grouping: words at distance one, found by the deletions they share, and the forms they lead to.

Every word emits itself and its distinct single deletions as keys, each with the places whose deletion gives it. Words meet on
shared keys; a pair is at distance one if one of the two is the key itself or both delete a common place. Keys are 64-bit
hashes, so that a word of any length emits short rows; all pairs are verified on the words themselves. The words that share a
key differ in one symbol of the alphabet at one of its places, so a key's words are bounded by the alphabet and its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tune, written
from .words import mix, texts

#: Runs of letters are words, after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Fixed values of the task: shortest word, least occurrences, how often a run is altered, how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, ALTERED, FACTOR = 7, 2, 31, 10
#: Characters of a text, words and code points that a task holds at a time.
SPAN, HELD_WORDS, HELD_POINTS = 1 << 20, 200_000, 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def altered(doc_id: str, run: str, crc: int | None = None) -> str:
    """The run as the document writes it: one of its code points is deleted if ALTERED divides the checksum of id and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()) if crc is None else crc)
    if h % ALTERED:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of batches of (id as text, text), summed while they fit."""
    run, gap = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), re.compile(f"[^{LETTERS}]")
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for ident, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            text = (data or b"").translate(_LOWER).decode("utf-8", "replace")
            crc = None if ident is None else zlib.crc32(f"{ident}:".encode())
            at = 0
            while at < len(text):
                # A text is read in spans that end where no run does.
                stop = gap.search(text, at + SPAN)
                end = stop.start() if stop else len(text)
                for word, n in Counter(run.findall(text, at, end)).items():
                    if crc is not None:
                        word = altered(ident, word, crc)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                at = end
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
    yield out()


def _deletions(words: list[str], ids: np.ndarray) -> pa.RecordBatch:
    """(key, id, first, last): hashes of the words (places -1) and of their distinct deletions with the places that give them."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[word]
    power = np.cumprod(np.full(int(sizes.max()), _BASE))
    term = mix(points + np.uint64(1)) * power[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(term)])
    whole = sums[starts + sizes] - sums[starts]
    before = sums[:-1] - sums[starts][word]
    # A deletion moves all that stands behind it one place to the front.
    without = before + (whole[word] - before - term) * _BASE_INVERSE
    new = np.flatnonzero((place == 0) | (points != np.concatenate([points[:1], points[:-1]])))
    ends = np.append(new[1:], len(points)) - 1
    key = np.concatenate([mix(whole ^ sizes.astype(np.uint64)), mix(without[new] ^ (sizes[word[new]] - 1).astype(np.uint64))])
    none = np.full(len(words), -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(np.concatenate([ids, ids[word[new]]])), pa.array(np.concatenate([none, place[new]]), pa.int32()), pa.array(np.concatenate([none, place[ends]]), pa.int32())],
        names=["key", "id", "first", "last"],
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, ids, size = [], [], 0
    for batch in batches:
        for ident, word in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.append(word.as_py())
            ids.append(ident)
            size += len(words[-1])
            if size >= HELD_POINTS:
                yield _deletions(words, np.array(ids, np.int64))
                words, ids, size = [], [], 0
    if words:
        yield _deletions(words, np.array(ids, np.int64))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least LEAST_LENGTH code points that occur at least LEAST_COUNT times."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: the ids of words(id, word) that differ by exactly one inserted, deleted or replaced code point.

    discard() of the result drops the table of deletions that it reads.
    """
    keys = written(words.select("id", "word").mapInArrow(_keys, "key long, id long, first int, last int"), "deletions")
    a, b = (keys.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "first", "last"))) for side in "ab")
    whole_a, whole_b = F.col("a_first") < 0, F.col("b_first") < 0
    one = F.when(whole_a | whole_b, whole_a != whole_b).otherwise((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a_id") < F.col("b_id")) & one).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("a_word")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("b_word")), "b")
    out = named.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b").distinct()
    out.written_path = keys.written_path
    return out


def _rooted(forms: DataFrame, most: int = 64) -> DataFrame:
    """(id, root) of forms(id, up): every id with the last of the chain up, by doubling the steps until none is left."""
    now = written(forms, "roots")
    for _ in range(most):
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        then = written(now.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then.select("id", "up")
        now.written_path = then.written_path
        if then.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root")
    raise RuntimeError(f"roots did not settle in {most} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root; n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least FACTOR times its
    own, else null. As n grows with each step, chains of forms end; the last one is the root, the word itself without a form.

    Null and empty texts have no words. Runs of documents with a null id are never altered. Rows are counted one by one, so
    repeated rows count repeatedly. Texts are read whole, in spans; a word of any length is compared. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    # Ids follow the order in which words are preferred as forms.
    ordered = word_counts(docs, id_col, text_col).repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    words = written(ordered.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    each = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = each.groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    held = words.join(near, "id", "left").join(best, "best", "left")
    is_form = F.col("form_n") >= FACTOR * F.col("n")
    kept = [F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n", "best")]
    table = written(held.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *kept), "forms")
    discard(pairs)
    roots = _rooted(table.where("best is not null").select("id", F.col("best").alias("up")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return table.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
