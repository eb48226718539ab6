import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake import operators as O
from strandlake.functions import packed as P

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def brute(seqs, k, canonical=True, homopolymer=False):
    out = Counter()
    for s in seqs:
        s = "".join(c.upper() if c in "acgtACGT" else "N" for c in s or "")
        if homopolymer:
            s = "".join(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if "N" not in w:
                out[min(w, w[::-1].translate(COMPLEMENT)) if canonical else w] += 1
    return out


def sequences(rng):
    base = "".join(rng.choice("ACGT") for _ in range(900))
    seqs = [base, base[100:500].lower(), base[:300] + "N" + base[300:640], "ü" + base[:260] + "ß" * 3, None, "", "ACG", "A" * 600, base[::-1].translate(COMPLEMENT)]
    return seqs + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(600))) for _ in range(12)]


@pytest.mark.parametrize("size", [64, 1 << 18])
def test_every_k_within_a_batch(size, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", size)
    monkeypatch.setattr(P, "HELD", 500)
    seqs = sequences(random.Random(1))
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.string())], names=["seq"])
    for k in [*range(1, 36), 47, 62, 63, 64, 65, 96, 97, 127, 128, 129, 200, 255, 256]:
        for canonical in (True, False):
            got = Counter()
            for out in P.packed_counts(k, canonical)(iter([batch.slice(0, 9), batch.slice(9)])):
                if k > P.PACKED:
                    out = next(P.unpacked(k)(iter([out])))
                    names = out.column(0).to_pylist()
                else:
                    names = ["".join("ACGT"[x >> 2 * i & 3] for i in reversed(range(k))) for x in out.column(0).to_pylist()]
                for name, n in zip(names, out.column(1).to_pylist()):
                    got[name] += n
            assert got == brute(seqs, k, canonical), (k, canonical)


def test_order_of_long_keys_is_that_of_kmers():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 3000).astype(np.uint8)
    for k in (40, 64, 100):
        keys, _ = P.all_windows(x, k, False)
        text = np.array([bytes(b"ACGT"[c] for c in x[i : i + k]) for i in range(len(keys))])
        assert (np.argsort(keys, kind="stable") == np.argsort(text, kind="stable")).all()


@pytest.mark.parametrize("k", [5, 11, 12, 31, 32, 64, 100, 256])
@pytest.mark.parametrize("homopolymer", [False, True])
def test_totals(spark, k, homopolymer):
    seqs = sequences(random.Random(k))
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string").repartition(3)
    got = O.totals(reads, O.CountConfig(k=k, homopolymer=homopolymer)).collect()
    assert len(got) == len({r["kmer"] for r in got}) and {r["kmer"]: r["count"] for r in got} == dict(brute(seqs, k, True, homopolymer))


def test_few_rows_leave_python():
    x = pa.array(["ACGTTGCA" * 4000] * 20)
    out = list(P.packed_counts(21, True)(iter([pa.RecordBatch.from_arrays([x], names=["seq"])])))
    assert sum(b.num_rows for b in out) <= 16 and sum(sum(b.column(1).to_pylist()) for b in out) == 20 * (32_000 - 20)


def test_time_is_in_proportion_to_length():
    seq = bytes(np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(3).integers(0, 4, 8_000_000)])
    spent = []
    for n in (2_000_000, 8_000_000):
        start = time.process_time()
        batch = pa.RecordBatch.from_arrays([pa.array([seq[:n]]).cast(pa.string())], names=["seq"])
        total = sum(b.column(1).to_numpy().sum() for b in P.packed_counts(21, True)(iter([batch])))
        spent.append(time.process_time() - start)
        assert total == n - 20
    assert spent[1] < 8 * spent[0] + 1


def reads_of(spark, rng):
    seqs = [s and s.replace("ACG", "acg", 2) for s in sequences(rng)] + ["AC" + "ä" * 3 + "ACGTACGTACGT😀ACGTACGT", "ACGTA", "NNNNNNNN"]
    return spark.createDataFrame([(i, s, s, "x", "y") for i, s in enumerate(seqs)], "read_id long, seq string, qual string, _hits string, _masked string")


@pytest.mark.parametrize("k", [5, 40])
def test_small_and_large_tables_give_the_same(spark, k):
    reads = reads_of(spark, random.Random(9))
    table = O.count(reads.limit(9), O.CountConfig(k=k, min_count=2, max_counter=1000))
    for run in (
        lambda n: O.counters(reads, table, small_rows=n),
        lambda n: O.filter_reads(reads, table, 2, 400, small_rows=n),
        lambda n: O.filter_reads(reads, table, 0.1, 0.9, small_rows=n),
        lambda n: O.trim_reads(reads, table, 2, small_rows=n),
        lambda n: O.mask_reads(reads, table, 3, small_rows=n),
        lambda n: O.mask_reads(reads, table, 0, small_rows=n),
    ):
        assert sorted(map(repr, run(None).collect())) == sorted(map(repr, run(0).collect()))
    masked = {r["read_id"]: r["seq"] for r in O.mask_reads(reads, table, 3).collect()}
    held = {r["kmer"]: r["count"] for r in table.df.collect()}
    for r in reads.collect():
        s, gone = r["seq"], set()
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k].translate(str.maketrans("acgt", "ACGT"))
            if held.get(min(w, w[::-1].translate(COMPLEMENT)), 0) < 3:
                gone |= set(range(i, i + k))
        assert masked[r["read_id"]] == (s and "".join("N" if i in gone else c for i, c in enumerate(s)))


def test_small_tables_need_no_shuffle_of_reads(spark):
    reads = reads_of(spark, random.Random(9))
    table = O.count(reads, O.CountConfig(k=5))
    plan = O.filter_reads(reads, table, 2, 400)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
