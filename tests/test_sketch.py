"""The sketched histogram against exact counts."""

import random

import numpy as np
import pytest

from strandlake import operators as O
from strandlake.functions.packed import codes
from strandlake.functions.sketch import hashes, slots, solved


@pytest.mark.parametrize("k", [1, 5, 31, 64, 200])
def test_hash_is_that_of_the_reverse_complement(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = hashes(codes(seq.encode()), k), hashes(codes(other.encode()), k)
    assert a.tolist() == b[::-1].tolist() and len(a) == 501 - k
    windows = {min(seq[i : i + k], other[500 - i - k : 500 - i]) for i in range(501 - k)}
    assert len(set(a.tolist())) == len(windows)


def test_windows_with_breaks_have_no_hash():
    assert len(hashes(codes(b"ACGTNACG"), 4)) == 1 and len(hashes(codes(b"AC"), 4)) == 0


def test_slots_are_even_and_copies_disjoint():
    found = np.random.default_rng(1).integers(0, 1 << 64, 200_000, np.uint64)
    got = slots(found, 2, 8)
    assert abs(len(got) - 100_000) < 1500 and got.min() == 0 and got.max() == 511
    assert np.bincount(got, minlength=512).std() < 20


def test_equations_give_back_a_known_mixture():
    # 60 % of k-mers once, 30 % twice, 10 % seven times, thrown into slots.
    rng, n = np.random.default_rng(2), 1 << 18
    times = rng.choice([1, 2, 7], 300_000, p=[0.6, 0.3, 0.1])
    counter = np.bincount(rng.integers(0, n, 300_000), weights=times, minlength=n).astype(int)
    total, found = solved(np.bincount(np.minimum(counter, 21), minlength=22)[1:], n, 0)
    assert abs(total - 300_000) < 3000
    for i, want in ((1, 180_000), (2, 90_000), (3, 0), (7, 30_000)):
        assert abs(found[i - 1] - want) < 4000


@pytest.mark.parametrize("k", [21, 70])
def test_sketch_is_near_the_exact_histogram(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(60_000))
    reads = []
    for _ in range(2000):
        at = rng.randrange(len(genome) - 150)
        reads.append((genome[at : at + 150],))
    df = spark.createDataFrame([*reads, (None,), ("",), ("ACN",)], "seq string").repartition(5)
    exact = {r["count"]: r["n"] for r in O.totals(df, O.CountConfig(k=k)).groupBy("count").count().withColumnRenamed("count(1)", "n").toDF("count", "n").collect()}
    got = {r["count"]: r["n_kmers"] for r in O.sketch_histogram(df, k, 30, 1, 16).collect()}
    everything = sum(exact.values())
    assert sorted(got) == list(range(31))
    assert abs(got[0] - everything) < 0.02 * everything
    assert all(abs(got[i] - exact.get(i, 0)) < 0.02 * everything for i in range(1, 31))


def test_empty_and_full_sketches(spark):
    none = spark.createDataFrame([], "seq string")
    assert {tuple(r) for r in O.sketch_histogram(none, 5, 3).collect()} == {(i, 0.0) for i in range(4)}
    rng = random.Random(3)
    rows = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(2000)),)], "seq string")
    with pytest.raises(Exception, match="raise sample_bits"):
        O.sketch_histogram(rows, 21, 3, 1, 4).collect()
