import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake import operators as O
from strandlake.functions import exchange as X

from test_packed import brute, sequences

KIND = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("counts", pa.binary())])


def handed(seqs, k, parts=7):
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.string())], names=["seq"])
    return [r for out in X.super_blobs(k, parts)(iter([batch.slice(0, 9), batch.slice(9)])) for r in out.to_pylist()]


def shuffled(df):
    """Bytes that the plan's only exchange handed on."""
    df.collect()
    node, found = [df._jdf.queryExecution().executedPlan()], []
    while node:
        x = node.pop()
        if x.nodeName() == "Exchange":
            found.append(x.metrics().get("dataSize").get().value())
        node += [x.children().apply(i) for i in range(x.children().size())]
    assert len(found) == 1
    return found[0]


@pytest.mark.parametrize("k", [pytest.param(64, id="wide"), pytest.param(27, id="long")])
def test_fewer_bytes_than_kmers_are_shuffled(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGT") for _ in range(60_000))
    reads = spark.createDataFrame([(text[i : i + 3000],) for i in range(0, len(text), 3000)], "seq string").coalesce(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # A row of its own for each k-mer took 40 bytes and more at k = 64, 24 at k = 27.
        assert shuffled(O.totals(reads, O.CountConfig(k=k))) < 20 * (3000 - k + 1) * 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("small", [False, True])
def test_parts_counted(small, monkeypatch):
    if small:
        monkeypatch.setattr(X, "SEGMENT", 64)
        monkeypatch.setattr(X, "HELD_BYTES", 3000)
        monkeypatch.setattr(X, "TURN_BYTES", 2000)
        monkeypatch.setattr(X, "ROWS", 9)
    seqs = sequences(random.Random(1))
    for k in [*range(12, 36), 47, 63, 64, 65, 96, 97, 128, 129, 255, 256]:
        for canonical in (True, False):
            got, parts = Counter(), {}
            for r in handed(seqs, k):
                parts.setdefault(r["part"], []).append(r)
            for rows in parts.values():
                for out in X.counted_parts(k, canonical)(iter([pa.RecordBatch.from_pylist([r], schema=KIND) for r in rows])):
                    names = out.column(0).to_pylist()
                    for name, n in zip(names if k > 31 else ["".join("ACGT"[x >> 2 * i & 3] for i in reversed(range(k))) for x in names], out.column(1).to_pylist()):
                        assert name not in got
                        got[name] = n
            assert got == brute(seqs, k, canonical), (k, canonical)


def test_equal_stretches_are_handed_on_once():
    line = "".join(random.Random(3).choice("ACGT") for _ in range(400))
    one, many = (sum(len(r["rows"]) for r in handed(seqs, 27)) for seqs in ([line], [line] * 500))
    assert one == many
    # A stretch of one symbol is rows of one kind, and one shorter.
    assert sum(len(r["counts"]) for r in handed(["A" * 300_000], 27)) <= 4 * 4
    assert handed(["", None, "ACGT", "N" * 99], 27) == []


@pytest.mark.parametrize("k, most", [pytest.param(27, 10, id="long"), pytest.param(64, 12, id="wide")])
def test_neighbours_overlap_and_take_few_bytes_when_written(k, most, tmp_path):
    rng, parts = random.Random(k), {}
    for r in handed(["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(60)], k):
        parts.setdefault(r["part"], []).append(r)
    out = [x for rows in parts.values() for x in X.counted_parts(k, True)(iter([pa.RecordBatch.from_pylist([r], schema=KIND) for r in rows]))]
    kmers = [x for b in out for x in b.column(0).to_pylist()]
    kmers = kmers if k > 31 else ["".join("ACGT"[x >> 2 * i & 3] for i in reversed(range(k))) for x in kmers]
    near = sum(any(a[: k - s] == b[s:] for s in range(1, 5)) for a, b in zip(kmers, kmers[1:]))
    assert near > 0.6 * len(kmers) > 0
    pq.write_table(pa.table({"kmer": kmers}), tmp_path / "k.parquet", compression="snappy", use_dictionary=False, column_encoding="PLAIN", write_statistics=False)
    # In their own order they took about 12 bytes at k = 27, in that of their hashes 32 at k = 64.
    assert (tmp_path / "k.parquet").stat().st_size < most * len(kmers)


@pytest.mark.parametrize("k, turn, many, most", [pytest.param(k, turn, many, most, id=f"{name}-{turn}") for k, name, most in ((27, "long", 10), (64, "wide", 12)) for turn, many in ((20_000, 20), (200, 2))])
def test_neighbours_overlap_however_large_a_part_is(k, turn, many, most, monkeypatch, tmp_path):
    # A part has 20 times and more what is held at a time; at 200, a single minimizer has more.
    monkeypatch.setattr(X, "TURN_BYTES", turn)
    rng = random.Random(k)
    rows = handed(["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(many)], k, 1)
    out = list(X.counted_parts(k, True)(iter([pa.RecordBatch.from_pylist(rows, schema=KIND)])))
    kmers = [x for b in out for x in b.column(0).to_pylist()]
    kmers = kmers if k > 31 else ["".join("ACGT"[x >> 2 * i & 3] for i in reversed(range(k))) for x in kmers]
    assert len(set(kmers)) == len(kmers) == many * (3000 - k + 1)
    pq.write_table(pa.table({"kmer": kmers}), tmp_path / "k.parquet", compression="snappy", use_dictionary=False, column_encoding="PLAIN", write_statistics=False)
    # Dealt to turns by hash, no neighbours were left.
    assert (tmp_path / "k.parquet").stat().st_size < most * len(kmers)


@pytest.mark.parametrize("k", [27, 64])
def test_large_counts_of_one_minimizer(k, monkeypatch):
    monkeypatch.setattr(X, "TURN_BYTES", 200)
    rng = random.Random(k)
    lines = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(4)] + ["A" * 400, "AC" * 150]
    seqs = [x for x, n in zip(lines, (1, 254, 255, 300, 2, 3)) for _ in range(n)]
    got = {}
    for out in X.counted_parts(k, True)(iter([pa.RecordBatch.from_pylist(handed(seqs, k, 1), schema=KIND)])):
        for name, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            name = name if k > 31 else "".join("ACGT"[name >> 2 * i & 3] for i in reversed(range(k)))
            assert name not in got
            got[name] = n
    assert got == brute(seqs, k, True)


def test_both_strands_have_one_minimizer():
    x = np.random.default_rng(5).integers(0, 4, 3000).astype(np.uint8)
    for k in range(12, 257):
        assert (X._lows(x, k) == X._lows(3 - x[::-1], k)[::-1]).all(), k


def test_rows_are_handed_on_column_by_column():
    rng = random.Random(2)
    rows = [r["rows"] for r in handed(["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(60)], 27)]
    size = X.row_size(27)
    assert all(sorted(r[: len(r) // size], reverse=True) == list(r[: len(r) // size]) for r in rows)
    # What short rows leave open is 0 and stands together, so that LZ4 takes little for it.
    assert sum(pa.Codec("lz4_raw").compress(r).size for r in rows) < 0.85 * sum(map(len, rows))


def test_words_of_one_hash_are_told_apart():
    a, b = (np.arange(1, 6, dtype=np.uint64) for _ in range(2))
    # The second word undoes what the first one gives the hash.
    words = [np.concatenate([a, a, a]), np.concatenate([np.uint64(0) - X._mixed(a), np.uint64(0) - X._mixed(b), a])]
    (first, second), n = X._summed(words, np.ones(15, np.int64))
    assert sorted(zip(first.tolist(), second.tolist(), n.tolist())) == sorted((x, y, c) for (x, y), c in Counter(zip(words[0].tolist(), words[1].tolist())).items())
