"""N-gram Jaccard join by parity sketches.

A document is its set of 5-word shingles. Hashing every shingle to a bit and XOR-ing gives a parity sketch: a shingle
that only one of two documents holds flips one bit at most, so the Hamming distance of two sketches never exceeds the
size of the symmetric difference, which for Jaccard similarity 0.75 is at most a third of the smaller set.

Pigeonhole per size band: the sketch is cut into blocks, as many as suit the band, and a document's blocks that are not
zero are its tokens. Two similar documents of a band differ in n // 3 tokens at most, so in any order that is the same for all
documents, the first n // 3 + 1 tokens of each have one in common. Tokens are ordered by how rare they are: those that one
document alone has come first and never leave it, so a document issues only as many shared tokens as it lacks
unshared ones. Tokens that a bounded sample shows to be common everywhere stand last, uncounted. A document near the upper end
of its band has tokens of the next band too. The rare documents with fewer tokens than that issue all of them, and single
shingles besides, by the same rule, which covers pairs of two such documents.

Documents with equal sets are one class from the start. First, each block's documents are compared with the least of
them and one drawn at random; a block whose documents are by then in one component needs no more. In the others, documents of
different components are all compared, in cells of bounded size. A pair is compared by size and whole sketch first; what passes
is verified on the sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, tune, written
from .components import components
from .words import HashCache, hashes, lists, mix, signed, texts, windows

#: The similarity that links, in percent; the block rule (a third of the smaller set) belongs to it.
PERCENT = 75
#: A band holds set sizes from FACTOR**j up to below FACTOR**(j+1); at its end a block holds LOAD shingles on average.
FACTOR, LOAD = 4, 2.2
#: Words of the folds that are compared before whole sketches, and how many earlier blocks a member row carries.
FOLDS, BACK = (1, 4, 8), 3
#: Documents of one block that a cell compares with as many others.
CELL = 1000
#: Documents looked at, on average, to find common tokens, and how many of them must hold one. Only the order in which tokens
#: are issued depends on this, never the result; at most (tokens of the sample) / COMMON_LEAST tokens are found.
COMMON_SAMPLE, COMMON_LEAST = 8000, 40
#: Parts into which the rows of a class of equal sets are dealt.
SALTS = 64
_U = np.uint64
_DOC = pa.struct([(n, pa.int64()) for n in ("doc_id", "n_shingles", "lo", "hi", "slack0", "slack1")] + [("sketch", pa.list_(pa.int64()))])
_SCAN = "key long, own long, salt int, doc struct<doc_id:bigint,n_shingles:bigint,lo:bigint,hi:bigint,slack0:bigint,slack1:bigint,sketch:array<bigint>>"
#: Parts of the tokens for each shuffle partition, and tokens that a task holds before it hands them on.
PARTS, HELD_TOKENS = 2, 1 << 20
_DEALT = f"part int, keys binary, owns binary, salts binary, {_SCAN[_SCAN.index('doc struct'):]}"
_TOKENS = f"key long, own long, n long, {_SCAN[_SCAN.index('doc struct'):]}"
#: The number that stands for a common token's documents, which are not counted.
MANY = 2**62


def shingles(text: bytes, cache: HashCache, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words than `width`, one for the whole sequence."""
    words = text.lower().split()  # lowers A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    found = np.sort(windows(hashes(words, cache), min(width, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values stand in `held`, which is in order and not empty."""
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def _tokens(u: np.ndarray, band: int) -> np.ndarray:
    """Keys of the non-zero blocks of a band."""
    blocks = int(FACTOR ** (band + 1) / LOAD) + 1
    at = ((u >> _U(32)) * _U(blocks)) >> _U(32)
    first = np.flatnonzero(np.diff(at, prepend=at[:1] + _U(1)))
    parity = np.bitwise_xor.reduceat(mix(u + _U(0x9E3779B97F4A7C15)), first)
    there = np.flatnonzero(parity)
    return mix(parity[there] + mix(at[first[there]] * _U(64) + _U(band + 1)))


def needed(n: int) -> int:
    """How many tokens a set of n shingles must issue; similar sets differ in fewer."""
    return n // 3 + 1


def token_lists(u: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """The tokens of a set in its band and, near its end, in the next one; the common ones of either, left out where the others
    suffice; single shingles where either has too few tokens."""
    n, none = len(u), np.zeros(0, np.uint64)
    if not n:
        return [none] * 5
    band = 0
    while FACTOR ** (band + 1) <= n:
        band += 1
    bands = [band, band + 1] if 100 * n >= PERCENT * FACTOR ** (band + 1) else [band]
    every = [_tokens(u, b) for b in bands]
    plain = [t[~_among(t, common)] for t in every] if len(common) else every
    more = [none if len(p) >= needed(n) else np.setdiff1d(t, p) for t, p in zip(every, plain)]
    singles = none if all(len(t) >= needed(n) for t in every) else mix(u[: needed(n)] ^ _U(0x5851F42D4C957F2D))
    return [plain[0], plain[1] if plain[1:] else none, more[0], more[1] if more[1:] else none, singles]


def parity_sketch(u: np.ndarray) -> np.ndarray:
    """Whole parity sketch in 64-bit words; its length is the power of two from twice the set's size on.

    The sketch of half the length is the XOR of its two halves.
    """
    bits = max(64, 1 << (2 * max(1, len(u)) - 1).bit_length())
    odd = np.bincount((mix(u) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _scan(common: np.ndarray):
    """One row per token (key, own, salt) and one per document (doc).

    `own` names a set and one of its three kinds of tokens. Common tokens have a salt from 1 to SALTS, others 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, done = HashCache(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, keys, owns, salts = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for k, text in enumerate(texts(batch.column(1))):
                u = shingles(text or b"", cache)
                d = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                lo, hi = (int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))
                every = token_lists(u, common)
                rows.append((len(u), lo, hi, *(needed(len(u)) - len(every[j]) - len(every[j + 2]) for j in range(2)), parity_sketch(u)))
                if batch.column(0)[k].is_valid:
                    keys += every
                    owns += [np.full(len(x), lo & -4 | j) for x, j in zip(every, (0, 1, 0, 1, 2))]
                    salts += [np.full(len(x), (done + k) % SALTS + 1 if j in (2, 3) else 0, np.int32) for j, x in enumerate(every)]
            *numbers, sketch = zip(*rows) if rows else [()] * 6
            docs = pa.StructArray.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in numbers), lists(list(sketch), pa.int64())], fields=list(_DOC))
            n, names = len(docs), ["key", "own", "salt", "doc"]
            spread = signed(mix(np.arange(done, done + n, dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), docs], names=names)
            flat = signed(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(owns)), pa.array(np.concatenate(salts)), pa.nulls(len(flat), _DOC)], names=names)
            done += n

    return run


def _common(src: DataFrame) -> np.ndarray:
    """The tokens that COMMON_LEAST of about COMMON_SAMPLE documents hold, picked by the hash of the row."""
    every = max(1, src.count() // COMMON_SAMPLE)
    some = src.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    tokens = some.mapInArrow(_scan(np.zeros(0, np.uint64)), _SCAN).where("doc is null")
    found = tokens.groupBy("key").count().where(F.col("count") >= COMMON_LEAST).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def _dealt(common: np.ndarray, parts: int):
    """The rows of _scan, dealt to parts by token and salt: those of documents as they are, the tokens of each part in three binaries."""
    names = ["part", "keys", "owns", "salts", "doc"]

    def handed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, owns, salts = (np.concatenate(c) for c in zip(*held))
        part = (mix(keys.view(np.uint64) + salts.astype(np.uint64)) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        some = np.flatnonzero(np.diff(ends))
        ends = ends[np.append(some, parts)]
        data = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in (keys, owns, salts.astype(np.uint8))]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *data, pa.nulls(len(some), _DOC)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _scan(common)(batches):
            n, columns = batch.num_rows, [c.to_numpy() for c in batch.columns[:3]]
            if batch.column(3).null_count < n:
                part = (columns[0].view(np.uint64) % _U(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.nulls(n, pa.binary()) for _ in range(3)), batch.column(3)], names=names)
                continue
            held.append(tuple(columns))
            size += n
            if size >= HELD_TOKENS:
                yield handed(held)
                held, size = [], 0
        if size:
            yield handed(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of _dealt: the rows of documents and, with the number n of sets, of tokens that two sets have."""
    names, parts = ["key", "own", "n", "doc"], [[np.zeros(0, kind)] for kind in (np.int64, np.int64, np.uint8)]
    for batch in batches:
        for held, column, kind in zip(parts, ("keys", "owns", "salts"), (np.int64, np.int64, np.uint8)):
            held += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(column) if x.is_valid]
        docs = batch.column("doc").drop_null()
        if len(docs):
            zeros = pa.array(np.zeros(len(docs), np.int64))
            yield pa.RecordBatch.from_arrays([zeros, zeros, zeros, docs], names=names)
    keys, owns, salts = (np.concatenate(held) for held in parts)
    del parts
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    # Most tokens stand alone; the others are put in order by token, salt and set.
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    kept = np.flatnonzero(again | (salts > 0))
    keys, owns, salts = keys[kept], owns[kept], salts[kept]
    order = np.lexsort((owns, salts, keys))
    keys, owns, salts = keys[order], owns[order], salts[order]
    place = np.concatenate([[True], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])[: len(keys)]
    once = place | np.concatenate([[True], owns[1:] != owns[:-1]])[: len(keys)]
    keys, owns, salts, place = keys[once], owns[once], salts[once], np.flatnonzero(place[once])
    n = np.diff(np.append(place, len(keys)))
    n = np.where(salts > 0, MANY, np.repeat(n, n))
    keys, owns, n = keys[n > 1], owns[n > 1], n[n > 1]
    for i in range(0, len(keys), 1 << 16):
        part = [pa.array(c[i : i + (1 << 16)]) for c in (keys, owns, n)]
        yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), _DOC)], names=names)


def _shared(src: DataFrame, common: np.ndarray) -> DataFrame:
    """The rows of documents and, with the number n of sets, of tokens that two sets have; one row per token and set.

    Tokens are shuffled in binaries, by token and salt, and met within their part.
    """
    parts = PARTS * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return src.mapInArrow(_dealt(common, parts), _DEALT).groupBy("part").applyInArrow(_met, _TOKENS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in batches:
        sets = [signed(shingles(text or b"", cache)) for text in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(sets, pa.int64())], names=["node", "items"])


def _apart(a: Column, b: Column) -> Column:
    """Hamming distance of two sketches, the longer folded to the shorter one's length."""

    def folded(x: Column, size: Column) -> Column:
        return F.when(F.size(x) <= size, x).otherwise(F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q)))

    size = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "u").join(right, "v")
        .where(_fits(F.size("a"), F.size("b")))
        .where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both))
        .select("u", "v")
    )


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) that their sizes and sketches leave possible."""
    left, right = (sketches.select(F.col("node").alias(e), F.col("n_shingles").alias(f"n_{e}"), F.col("sketch").alias(f"s_{e}")) for e in ("u", "v"))
    near = _fits(F.col("n_u"), F.col("n_v")) & (7 * _apart(F.col("s_u"), F.col("s_v")) <= F.col("n_u") + F.col("n_v"))
    return written(pairs.join(left, "u").join(right, "v").where(near).select("u", "v").distinct(), "pairs")


def _linked(pairs: DataFrame, src: DataFrame, repeated: bool) -> DataFrame:
    """The pairs whose texts' sets are similar enough; only the texts of pairs are read again."""
    ids = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = src.join(ids, src["doc_id"] == ids["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = texts.mapInArrow(_sets, "node long, items array<long>").where("size(items) > 0")
    sets = written(sets.dropDuplicates() if repeated else sets, "sets")
    out = written(_verified(pairs, sets).distinct(), "links")
    discard(sets)
    return out


def _stars(members: DataFrame) -> DataFrame:
    """Each member of a block with the least one, and with the first in one of four random orders, picked by the key."""
    drawn = F.min_by("node", F.xxhash64("node", F.pmod("key", F.lit(4))))
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(F.min("node"), drawn)).alias("hubs"))
    each = members.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    return each.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _folded(sketch: Column, words: int) -> Column:
    """The sketch folded to `words` 64-bit words by XOR; null if it is shorter."""
    word = lambda i: F.aggregate(F.filter(sketch, lambda _, j: j % words == i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) >= words, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word))


def _across(members: DataFrame, edges: DataFrame, sketches: DataFrame, repeated: bool) -> DataFrame:
    """The pairs of each block that lie in two components and that sizes and sketches leave possible.

    Each member row of a block carries its document's last few blocks before. If two documents share one of these, they were
    compared there or earlier, as any pair is at its first shared block. What is left is compared on short folds of
    the sketches, then on the whole ones.
    """
    comp = components(edges)
    now = members.join(comp.withColumnRenamed("node", "member"), members["node"] == F.col("member"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    now = written(now.distinct() if repeated else now, "labelled")
    still = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count("*") / CELL).cast("int").alias("parts")).where("a < b").select("key", "parts")
    order = Window.partitionBy("node").orderBy("key")
    last = [f"before{i}" for i in range(1, BACK + 1)]
    back = now.join(still, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("*", *(F.lag("key", i).over(order).alias(c) for i, c in enumerate(last, 1)))
    folds = [f"fold{w}" for w in FOLDS]
    short = written(sketches.select("*", *(_folded(F.col("sketch"), w).alias(c) for w, c in zip(FOLDS, folds))), "folded")
    side = written(back.join(short, "node"), "open")
    discard(now)
    discard(short)
    # A block of more than CELL documents is cut into parts, and each pair of parts is a cell of its own.
    parts = F.col("parts")
    left, right = (
        side.withColumn("other", F.explode(places)).select(
            "key", (F.least("part", "other") * parts + F.greatest("part", "other")).alias("cell"), *(F.col(c).alias(f"{c}_{e}") for c in ("part", "node", "component", "n_shingles", "sketch", *last, *folds))
        )
        for e, places in (("u", F.sequence(F.col("part"), parts - 1)), ("v", F.sequence(F.lit(0), F.col("part"))))
    )
    total = F.col("n_shingles_u") + F.col("n_shingles_v")
    near = ((F.col("part_u") < F.col("part_v")) | (F.col("node_u") < F.col("node_v"))) & (F.col("component_u") != F.col("component_v")) & _fits(F.col("n_shingles_u"), F.col("n_shingles_v"))
    for x in last:
        for y in last:
            near &= ~F.coalesce(F.col(f"{x}_u") == F.col(f"{y}_v"), F.lit(False))
    for w, c in zip(FOLDS, folds):
        flips = sum((F.bit_count(F.get(f"{c}_u", F.lit(i)).bitwiseXOR(F.get(f"{c}_v", F.lit(i)))) for i in range(1, w)), F.bit_count(F.get(f"{c}_u", F.lit(0)).bitwiseXOR(F.get(f"{c}_v", F.lit(0)))))
        near &= F.coalesce(7 * flips <= total, F.lit(True))
    near &= 7 * _apart(F.col("sketch_u"), F.col("sketch_v")) <= total
    pair = [F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")]
    out = written(left.join(right, ["key", "cell"]).where(near).select(*pair).distinct(), "pairs")
    discard(side)
    return out


def _classed(held: DataFrame) -> DataFrame:
    """held with `node`, the smallest id of the rows with an equal set; the rows of one class are dealt to SALTS parts."""
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = dealt.groupBy("lo", "hi", "salt").agg(F.min("doc_id").alias("node"))
    least = parts.groupBy("lo", "hi").agg(F.min("node").alias("node"), F.collect_set("salt").alias("salts")).select("lo", "hi", "node", F.explode("salts").alias("salt"))
    return dealt.join(least, ["lo", "hi", "salt"]).drop("salt")


def _members(tokens: DataFrame, leads: DataFrame) -> DataFrame:
    """(key, node): the tokens that sets issue, the rarest first.

    By `slack` a set must issue more shared tokens than it has; where it is below 0, as many of the last ones are kept back.
    """
    tokens = tokens.where(F.col("n") < MANY).unionByName(tokens.where(F.col("n") == MANY).distinct())
    slack = [F.col("slack0"), F.col("slack1"), F.lit(0).cast("long")]
    kinds = F.array(*(F.struct(F.col("lo").bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(j)).alias("own"), slack[j].alias("slack")) for j in range(3)))
    units = leads.select(F.col("doc_id").alias("node"), F.explode(kinds).alias("x")).select("node", "x.own", "x.slack")
    mine = Window.partitionBy("own")
    ranked = tokens.withColumn("place", F.row_number().over(mine.orderBy("n", "key"))).withColumn("held", F.count("*").over(mine))
    return ranked.join(units, "own").where(F.col("place") <= F.col("slack") + F.col("held")).select("key", "node").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when 100 * |A and B| >= 75 * |A or B|. Null texts and texts without words have no shingles and
    link with nothing; their component is their own id. Rows with a null id get a null component. Rows that share an
    id are one document that links by any of its texts. Other columns are not read; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scan = written(_shared(src, _common(src)), "shared")
    all_docs = scan.where("doc is not null").select("doc.*")
    held = all_docs.where("doc_id is not null and n_shingles > 0")
    classes = written(_classed(held.drop("sketch")), "classes")
    leads = classes.where("doc_id = node").select("doc_id", "lo", "slack0", "slack1").distinct()
    members = written(_members(scan.where("doc is null").select("key", "own", "n"), leads), "members")
    found = members.select("node").distinct()
    narrow = held.select("doc_id", "n_shingles", "sketch")
    sketches = written(narrow.join(found, narrow["doc_id"] == found["node"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sketch"), "sketches")
    counts = written(all_docs.select("doc_id", "n_shingles"), "counts")
    discard(scan)
    repeated = bool(counts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
    if repeated:
        sketches = sketches.dropDuplicates()

    # Ids whose rows fell into several classes tie these classes together.
    ties = classes.groupBy("doc_id").agg(F.min("node").alias("u"), F.collect_set("node").alias("all")).where("size(all) > 1").select("u", F.explode("all").alias("v")).where("u <> v")
    first = _linked(_close(_stars(members), sketches), src, repeated)
    edges = written(ties.unionByName(first), "edges")
    rest = _linked(_across(members, edges, sketches, repeated), src, repeated)
    discard(members)
    comp = components(edges.unionByName(rest))
    named = classes.select("doc_id", "node").join(comp.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = written(named.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id")), "named")
    return counts.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
