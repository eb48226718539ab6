import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake import functions as K
from strandlake import operators as O
from strandlake.plans import complex_definition, evaluate
from strandlake.sources import read_fasta, read_fastq, read_list, write_dump, write_fasta, write_fastq, write_histogram


def table(spark, rows, k=3, **meta):
    return O.KmerTable(spark.createDataFrame(rows, "kmer string, count long"), O.KmerMeta(k, **meta))


def rows(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


def test_palindrome(spark):
    reads = spark.createDataFrame([(0, "AACTGACATGTCAGTT")], "read_id long, seq string")
    got = rows(O.count(reads, O.CountConfig(k=5)).df)
    assert got == {x: 2 for x in ("AACTG", "ACATG", "ACTGA", "ATGTC", "CTGAC", "TGACA")}


def test_cutoffs_before_clamp(spark):
    reads = spark.createDataFrame([("A" * 12,), ("CCC",), ("gggN",), (None,), ("AC",)], "seq string")
    assert rows(O.count(reads, O.CountConfig(k=3, canonical=False, min_count=1, max_counter=5)).df) == {"AAA": 5, "CCC": 1, "GGG": 1}
    assert rows(O.count(reads, O.CountConfig(k=3, min_count=2, max_count=9)).df) == {"CCC": 2}


def test_long_runs_are_cut_without_loss(spark):
    seq = "ACGTTGCAAC" * 2000
    got = rows(O.totals(spark.createDataFrame([(seq,)], "seq string"), O.CountConfig(k=7, canonical=False)))
    assert sum(got.values()) == len(seq) - 6


@pytest.mark.parametrize("kmer, size, number", [("ACGGATGCAGTGCTAGCGGTGGCC", 7, 1436), ("AAAAAAAAAAAAAAAAGC", 5, 4**5)])
def test_signature(spark, kmer, size, number):
    got = spark.range(1).select(K.signature_number(K.signature(F.lit(kmer), size), size).alias("n")).first()["n"]
    assert int(got) == number


def test_set_operations(spark):
    a, b = table(spark, [("AAA", 5), ("CCC", 3), ("ACA", 4)]), table(spark, [("AAA", 3), ("CCC", 5), ("GGA", 4)])
    assert rows(O.combine(a.df, b.df, "intersect")) == {"AAA": 3, "CCC": 3}
    assert rows(O.combine(a.df, b.df, "union")) == {"AAA": 8, "CCC": 8, "ACA": 4, "GGA": 4}
    assert rows(O.combine(a.df, b.df, "counters_subtract")) == {"AAA": 2, "ACA": 4}
    assert rows(O.combine(a.df, b.df, "reverse_kmers_subtract")) == {"GGA": 4}
    assert rows(evaluate("(a + min b) * b", {"a": a, "b": b}).df) == {"AAA": 3, "CCC": 3, "GGA": 4}
    with pytest.raises(ValueError):
        evaluate("a + ", {"a": a})


def test_default_union_saturates(spark):
    a, b = table(spark, [("AAA", 200)], counter_size=1), table(spark, [("AAA", 100)], counter_size=1)
    assert rows(O.simple(a, b, "union").df) == {"AAA": 255}


def test_definition(spark):
    t = table(spark, [("AAA", 5), ("CCC", 50)])
    path, out = complex_definition("INPUT:\ns1 = x -ci10\ns2 = y\nOUTPUT:\nres = s1 * s2\nOUTPUT_PARAMS:\n-cs7\n", lambda p: t)
    assert path == "res" and rows(out.df) == {"CCC": 7}


def test_histogram_is_dense(spark):
    got = {r["count"]: r["n_kmers"] for r in table(spark, [("AAA", 1), ("CCC", 3)]).histogram(1, 4).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}


def test_reads(spark):
    t = table(spark, [("AAC", 5), ("ACC", 5)])
    reads = spark.createDataFrame([(0, "AACCN"), (1, "AC"), (2, "AACTT"), (3, "CCCCC")], "read_id long, seq string")
    by_id = lambda df: {r["read_id"]: r["seq"] for r in df.collect()}
    assert set(by_id(O.filter_reads(reads, t, 1, 9))) == {0, 2}
    assert by_id(O.trim_reads(reads, t, 2)) == {0: "AACC", 2: "AAC"}
    assert by_id(O.mask_reads(reads, t, 2)) == {0: "AANNN", 1: "AC", 2: "ANNNN", 3: "NNNNN"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x 1\nACG\nTT\n>y\n\n>z\nAC")
    (tmp_path / "a.fq").write_text("@\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@@\n")
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [("x 1", "ACGTT"), ("y", ""), ("z", "AC")]
    assert sorted(tuple(r) for r in read_fastq(spark, str(tmp_path / "a.fq")).collect()) == [("", "ACGT", "IIII"), ("r2", "GG", "@@")]


def test_sources_refuse_what_is_malformed(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s a->b\nAC\n>t >u\r\nGT\r\n")
    (tmp_path / "b.fa").write_text("ACGT\n>x\nAC\n")
    (tmp_path / "c.fq").write_text("@a\nACG\n+\nII\n")
    (tmp_path / "d.fq").write_text("a\nACG\n+\nIII\n")
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [("s a->b", "AC"), ("t >u", "GT")]
    for read, name in ((read_fasta, "b.fa"), (read_fastq, "c.fq"), (read_fastq, "d.fq")):
        with pytest.raises(Exception, match="FAST"):
            read(spark, str(tmp_path / name)).collect()


def test_files_are_read_in_splits(spark, tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 5), "@+I\\" * (i % 5)) for i in range(3000)]
    (tmp_path / "a.fq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in want) + "\n\n")
    (tmp_path / "b.fa").write_text("".join(f">{h}\n{s}\n{s}\n" for h, s, _ in want))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("@z\nAC\n+\n@@\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fq\n\n{tmp_path}/c.fq.gz\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        fq, fa = read_fastq(spark, read_list(spark, str(tmp_path / "list"))), read_fasta(spark, str(tmp_path / "b.fa"))
        assert fa.rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in fq.collect()) == sorted([*want, ("z", "AC", "@@")])
        assert sorted(tuple(r) for r in fa.collect()) == sorted((h, s * 2) for h, s, _ in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", "@@")], "header string, seq string, qual string")
    write_fasta(reads, f"{tmp_path}/fa")
    write_fastq(reads, f"{tmp_path}/fq")
    assert sorted(r["seq"] for r in read_fasta(spark, f"{tmp_path}/fa").collect()) == ["ACGT", "GG"]
    assert sorted(tuple(r) for r in read_fastq(spark, f"{tmp_path}/fq").collect()) == sorted(tuple(r) for r in reads.collect())
    with pytest.raises(ValueError):
        write_fastq(reads.drop("qual"), f"{tmp_path}/no")
    t = table(spark, [("CCC", 3), ("AAA", 1)])
    write_dump(t, f"{tmp_path}/dump", ordered=True)
    write_histogram(t.histogram(1, 3), f"{tmp_path}/hist")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/dump").collect()] == ["AAA\t1", "CCC\t3"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/hist").collect()) == ["1\t1", "2\t0", "3\t1"]


def test_tables_are_kept_and_looked_up(spark, tmp_path):
    t = table(spark, [("AAA", 1), ("CCC", 5), ("ACG", 9)], min_count=1, max_count=9)
    t.save(f"{tmp_path}/t")
    back = O.KmerTable.load(spark, f"{tmp_path}/t")
    assert back.meta == t.meta and sorted(back.rows()) == [("AAA", 1), ("ACG", 9), ("CCC", 5)]
    assert back.check("CCC") == 5 and back.check("GGG") == 0 and back.is_kmer("AAA") and back.n_kmers() == 3
    narrow = back.limited_to(2, 8)
    assert sorted(narrow.rows()) == [("CCC", 5)] and narrow.check("AAA") == 0
    for low, high in ((0, 10), (6, 5)):
        with pytest.raises(ValueError):
            back.limited_to(low, high)
    with pytest.raises(ValueError):
        back.dump(1, 10)
    with pytest.raises(ValueError):
        back.check("AC")


@pytest.mark.parametrize("k", [1, 2, 30, 31, 32, 33, 64, 255, 256])
def test_counts_at_every_width(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=300)) for _ in range(2)] + ["ACGT" * 90 + "N" + "A" * 280, "acgt" * 3]
    flip = str.maketrans("ACGT", "TGCA")
    want = Counter()
    for s in seqs:
        for run in s.upper().split("N"):
            for i in range(len(run) - k + 1):
                f = run[i : i + k]
                want[min(f, f.translate(flip)[::-1])] += 1
    got = rows(O.totals(spark.createDataFrame([(s,) for s in seqs], "seq string"), O.CountConfig(k=k)))
    assert got == dict(want)


def test_packed_words(spark):
    df = spark.createDataFrame([("ACGT",), ("T" * 33,), ("C" * 70,)], "kmer string")
    value = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    for r in df.select("kmer", K.to_words(F.col("kmer")).alias("w")).collect():
        n = 0
        for word in r["w"]:
            n = (n << 64) + int(word)
        assert n == value(r["kmer"]) and len(r["w"]) == -(-len(r["kmer"]) // 32)


def test_summary(spark):
    reads = spark.createDataFrame([(0, "AACTGACATGTCAGTT"), (1, "NNACG")], "read_id long, seq string")
    r = O.summary(reads, O.CountConfig(k=5, signature_len=3)).first()
    assert r["n_super_kmers"] == O.super_kmers(reads, 5, 3).count() and json.loads(r["json"])["Stats"]["#Total no. of k-mers"] == r["n_total"] == 12


def test_outputs_have_limits_of_their_own(spark):
    a, b = table(spark, [("AAA", 5), ("CCC", 3), ("ACA", 4)]), table(spark, [("AAA", 3), ("CCC", 5)])
    out = O.simple_many(a, b, {"i": ("intersect", None), "u": ("union", None, {"min_count": 5, "max_counter": 6}), "s": ("kmers_subtract", None, {"max_count": 3})})
    assert rows(out["i"]) == {"AAA": 3, "CCC": 3} and rows(out["u"]) == {"AAA": 6, "CCC": 6} and rows(out["s"]) == {}


def test_fractions_are_for_the_filter_only(spark):
    t = table(spark, [("AAC", 5)])
    reads = spark.createDataFrame([(0, "AACCN")], "read_id long, seq string")
    for operator in (O.trim_reads, O.mask_reads):
        with pytest.raises(ValueError):
            operator(reads, t, 0.5)


def test_long_reads_are_masked_in_parts(spark):
    rng = random.Random(1)
    seq = "".join(rng.choices("ACGT", k=5000))
    kept = {seq[i : i + 7] for i in range(0, 4994) if not (1010 < i < 1030 or 2040 < i < 2048 or i > 4900)}
    flip = str.maketrans("ACGT", "TGCA")
    t = table(spark, [(x, 9) for x in {min(x, x.translate(flip)[::-1]) for x in kept}], k=7)
    ok = lambda f: min(f, f.translate(flip)[::-1]) in {min(x, x.translate(flip)[::-1]) for x in kept}
    good = [ok(seq[i : i + 7]) for i in range(4994)]
    want = "".join("N" if not all(good[max(0, i - 6) : i + 1]) else c for i, c in enumerate(seq))
    got = O.mask_reads(spark.createDataFrame([(0, seq, "x")], "read_id long, seq string, other string"), t, 2).first()
    assert got["seq"] == want and got["other"] == "x" and "N" in want
    cut = O.trim_reads(spark.createDataFrame([(0, seq)], "read_id long, seq string"), t, 2).first()["seq"]
    assert cut == seq[: good.index(False) + 6]


def test_wide_limits(spark):
    with pytest.warns(UserWarning, match="limited"):
        assert O.CountConfig(k=10, max_count=1 << 40).max_count == (1 << 32) - 1
    assert O.CountConfig(k=9, max_counter=1 << 40).max_counter == 1 << 40
    with pytest.raises(ValueError):
        O.CountConfig(k=257)


@pytest.mark.parametrize("stretch", [1, 2, 7, 50])
def test_super_kmers_of_pieces(spark, stretch):
    rng = random.Random(stretch)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (4, 9, 10, 60, 301)] + ["A" * 80, "TTT" * 9 + "ACG" * 30 + "N" + "GATTACA" * 20, "", None, "NNN", "A" * 40 + "C" * 40 + "A" * 40]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    whole = sorted(map(tuple, O.super_kmers(reads, 9, 5).collect()))
    assert {r[0] for r in whole} == {2, 3, 4, 5, 6, 1, 10}
    assert sorted(map(tuple, O.super_kmers(reads, 9, 5, stretch=stretch).collect())) == whole
    # Against the signatures of single k-mers: stretches tile each run, and neighbours differ.
    every = {}
    for read, run_no, start, length, sig in whole:
        every.setdefault((read, run_no), []).append((start, length - 8, sig))
    for parts in every.values():
        assert all(a[0] + a[1] == b[0] and a[2] != b[2] for a, b in zip(parts, parts[1:]))
        assert parts[0][0] == 0
