"""Cross-tokenizer alignment: which ids of one tokenizer stand for which ids of another, counted over a corpus.

A document's tokens are cut into groups where both tokenizers end a token at the same byte. Distinct groups are interned in a
dictionary; links (pairs of an A id and a B id in one group) are expanded once for each distinct group and counted by the number
of documents that hold the group. A pair that several groups of one document hold is counted once for it: the surplus is taken
from the entry of the group of that pair alone, where the occurrences are counted. Results go back to documents by group.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune, written

#: Both tokenizers end a token where a space follows something other than white space.
FRONT = re.compile(r"(?<=[\S\x1c-\x1f])(?= )")
#: Characters of a text, different pieces of texts and groups that a task holds at a time.
SPAN, HELD_PIECES, HELD_GROUPS = 1 << 20, 300_000, 200_000
#: Groups whose results are sent to all executors, the most frequent first; the others go by a join.
SENT_GROUPS = 200_000

_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>, key long, name string, n_docs long"


class Encoders:
    """The two tokenizers with the bytes of their ids."""

    def __init__(self, ranks: str, pattern: str, model: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size_a = [0] * (max(table.values()) + 1)
        for part, i in table.items():
            self.size_a[i] = len(part)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.text_a, self.text_b = list(map(str, range(len(self.size_a)))), list(map(str, range(len(names))))

    def groups(self, pieces: list[str]) -> Iterator[tuple[int, int, list[str], int] | None]:
        """(A tokens, B tokens, names of the groups, links) of pieces that begin with a space; None where B's tokens give other bytes."""
        # B adds the space itself, but not to nothing.
        for piece, ids_b in zip(pieces, self.b.encode([p[1:] for p in pieces], num_threads=1)):
            ids_a, ids_b = self.a.encode_ordinary(piece), ids_b or [self.space]
            parts = [self.bytes_b[i] for i in ids_b]
            if b"".join(parts) != piece.encode():
                yield None
                continue
            sizes_a, sizes_b = [self.size_a[i] for i in ids_a], list(map(len, parts))
            of_a, of_b = [self.text_a[i] for i in ids_a], [self.text_b[i] for i in ids_b]
            if sizes_a == sizes_b:
                yield len(ids_a), len(ids_b), [f"{a}|{b}" for a, b in zip(of_a, of_b)], len(ids_a)
                continue
            names, links, i, j = [], 0, 0, 0
            while i < len(sizes_a):
                ahead, from_i, from_j = sizes_a[i] - sizes_b[j], i, j
                i, j = i + 1, j + 1
                if not ahead:
                    names.append(f"{of_a[from_i]}|{of_b[from_j]}")
                    links += 1
                    continue
                while ahead:
                    if ahead < 0:
                        ahead += sizes_a[i]
                        i += 1
                    else:
                        ahead -= sizes_b[j]
                        j += 1
                names.append(f"{','.join(of_a[from_i:i])}|{','.join(of_b[from_j:j])}")
                links += (i - from_i) * (j - from_j)
            yield len(ids_a), len(ids_b), names, links


def _key(name: str) -> int:
    x = xxhash.xxh3_64_intdigest(name)
    return x - (1 << 64) if x >> 63 else x


class Dictionary(dict):
    """piece -> (tokens of A, of B, links, groups as text, group keys), with the names of the keys and the pairs of larger groups."""

    def __init__(self, encoders: Encoders):
        self.encoders, self.names, self.keys_of, self.pairs = encoders, {}, {}, {}

    def key(self, name: str) -> int:
        """The key of a group, which is interned with its pairs when first met."""
        key = self.keys_of[name] = _key(name)
        self.names[key] = name
        if "," in name:
            a, b = (set(x.split(",")) for x in name.split("|"))
            self.pairs[key] = tuple(self.keys_of.get(f"{x}|{y}") or self.key(f"{x}|{y}") for x in a for y in b)
        return key

    def add(self, pieces: list[str]) -> None:
        """Takes in all pieces that are new."""
        new = list({p for p in pieces if p not in self})
        known = self.keys_of
        for piece, got in zip(new, self.encoders.groups(new)):
            if got is None:
                self[piece] = None
            else:
                n_a, n_b, names, links = got
                self[piece] = (n_a, n_b, links, ";".join(names).encode(), tuple([known[x] if x in known else self.key(x) for x in names]))

    def forget(self) -> None:
        for held in (self, self.names, self.keys_of, self.pairs):
            held.clear()


def pieces(text: str) -> Iterator[list[str]]:
    """The text cut at FRONT, a span at a time."""
    at = 0
    while at < len(text):
        stop = FRONT.search(text, at + SPAN)
        end = stop.start() if stop else len(text)
        yield FRONT.split(text[at:end])
        at = end


def _document(text: str, held: Dictionary):
    """(tokens of A, of B, groups, links, digest, {group: times}) of a text; None where the bytes differ."""
    n_a = n_b = n_links = 0
    digest, times, first = hashlib.sha256(), Counter(), True
    for part in pieces(" " + text):
        held.add(part)
        entries = list(map(held.__getitem__, part))
        if None in entries:
            return None
        a, b, links, names, keys = zip(*entries)
        n_a += sum(a)
        n_b += sum(b)
        n_links += sum(links)
        digest.update((b"" if first else b";") + b";".join(names))
        times.update(chain.from_iterable(keys))
        first = False
    return n_a, n_b, sum(times.values()), n_links, digest.hexdigest(), times


def _aligned(ranks: str, pattern: str, model: str):
    fields = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times", "key", "name", "n_docs"]
    long = pa.int64()
    types = [long, long, long, long, long, long, pa.string(), pa.list_(long), pa.list_(pa.int32()), long, pa.string(), long]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(fields), types)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Dictionary(Encoders(ranks, pattern, model))
        docs: Counter = Counter()
        # Entries hold no cycles; without this, the collector walks all of them again and again.
        gc.disable()

        def entries() -> Iterator[pa.RecordBatch]:
            rows = [(None,) * 9 + (k, held.names[k], n) for k, n in docs.items()]
            for i in range(0, len(rows), 10_000):
                yield made(rows[i : i + 10_000])
            docs.clear()

        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                value = text.as_py()
                got = _document(value, held) if value else None
                if got is None:
                    rows.append((row, doc_id, 0, 0, 0, 0, "", [], [], None, None, None))
                    continue
                times = got[-1]
                docs.update(times.keys())
                several = [held.pairs[k] for k in times if k in held.pairs]
                for pair, n in Counter(chain.from_iterable(several)).items():
                    surplus = n - 1 + (pair in times)
                    if surplus:
                        docs[pair] -= surplus
                rows.append((row, doc_id, *got[:-1], list(times.keys()), list(times.values()), None, None, None))
            yield made(rows)
            if len(held) >= HELD_PIECES or len(docs) >= HELD_GROUPS:
                yield from entries()
            if len(held) >= HELD_PIECES:
                held.forget()
        yield from entries()
        gc.enable()

    return run


def valued(entries: DataFrame) -> DataFrame:
    """(key, n_docs, n_best, count_sum) of each distinct group of entries(key, name, n_docs): what one occurrence of it adds."""
    groups = written(entries.groupBy("key", "name").agg(F.sum("n_docs").alias("n_docs")), "groups")
    if not groups.groupBy("key").count().where("count > 1").isEmpty():
        raise RuntimeError("two groups have one key")
    ids = lambda i: F.explode(F.split(F.split("name", r"\|")[i], ",").cast("array<int>"))
    each = groups.select("key", "n_docs", "name", ids(0).alias("a")).groupBy("key", "n_docs", "name", "a").agg(F.count("*").alias("m"))
    each = each.select("key", "n_docs", "a", "m", ids(1).alias("b")).groupBy("key", "n_docs", "a", "b").agg(F.sum("m").alias("times"))
    links = written(each, "links")
    pairs = written(links.groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "pairs")
    # One row for each A id, as many as the vocabulary at most.
    best = pairs.groupBy("a").agg(F.max("count").alias("most"))
    joined = links.join(pairs, ["a", "b"]).join(F.broadcast(best), "a")
    return joined.groupBy("key", "n_docs").agg(F.sum(F.when(F.col("count") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def align(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT_GROUPS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B adds the space itself. n_best counts links whose pair is in as many documents as any pair
    of its A id; count_sum adds the documents of each link's pair. Null and empty texts and texts whose bytes a tokenizer changes have no
    tokens: zeros and an empty digest. Rows are judged one by one: repeated rows count as documents of their own and ids may be
    null. Texts are read whole, in spans. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = written(src.mapInArrow(_aligned(ranks, pattern, model), _ROWS), "aligned")
    values = written(valued(made.where("key is not null").select("key", "name", "n_docs")), "values")
    # How many groups have at least 2**p documents; one row for each p.
    level = F.floor(F.log2(F.greatest("n_docs", F.lit(1)))).cast("int")
    held, least = 0, 64
    for r in sorted(values.groupBy(level.alias("p")).count().collect(), key=lambda r: -r["p"]):
        held += r["count"]
        if held > sent:
            break
        least = r["p"]
    value = values.select("key", "n_best", "count_sum")
    frequent = values.where(level >= least).select(*value.columns)
    lines = made.where("row is not null")
    each = lines.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    add = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_best", "count_sum")]
    met = each.join(F.broadcast(frequent), "key", "left")
    sums = met.where("count_sum is not null").groupBy("row").agg(*add)
    if held > sent:
        rest = met.where("count_sum is null").select("row", "key", "times").join(values.where(level < least).select(*value.columns), "key").groupBy("row").agg(*add)
        sums = sums.unionByName(rest).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    more = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return lines.drop("keys", "times", "key", "name", "n_docs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")
