"""FASTQ and FASTA read block by block, at every block size, against plain reading of the whole text."""

import random

import pytest

from strandlake import operators as O
from strandlake.sources import read_fasta_pieces, read_fastq


@pytest.fixture
def blocks_of(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        for n in names:
            spark.conf.set(n, str(size if n == names[0] else 1))

    yield set_size
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 60, 257, 4000])
def test_fastq_finds_records_in_every_block(spark, tmp_path, blocks_of, size):
    rng = random.Random(size)
    records = []
    for i in range(60):
        n = rng.choice([0, 1, 5, 40])
        # Qualities begin with @ and + often, which are no headers.
        qual = "".join(rng.choice("@+I>") for _ in range(n))
        records.append((f"r{i} @+", "".join(rng.choice("ACGTN") for _ in range(n)), qual))
    text = "".join(f"@{h}\n{s}\n+{h}\n{q}\n" for h, s, q in records)
    (tmp_path / "a.fq").write_text(text + "\n" * rng.randrange(6))
    (tmp_path / "b.fq").write_text("@z\nAC\n+\n@@")
    blocks_of(size)
    got = read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
    assert sorted(tuple(r) for r in got.collect()) == sorted([*records, ("z", "AC", "@@")])


def test_fastq_lost_line_is_an_error(spark, tmp_path, blocks_of):
    lines = [x for i in range(50) for x in (f"@r{i}", "ACGT", "+", "IIII")]
    del lines[101]
    (tmp_path / "a.fq").write_text("\n".join(lines))
    for size in (90, 10_000):
        blocks_of(size)
        with pytest.raises(Exception, match="malformed FASTQ"):
            read_fastq(spark, str(tmp_path / "a.fq")).collect()


def test_fastq_exchanges_edges_only(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nAC\n+\nII\n")
    plan = read_fastq(spark, str(tmp_path / "a.fq"))._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("Union") :].split("Window")[0]
    # The branch of whole records comes before that of the edges, whose exchange stands under the window.
    assert "MapInArrow" in first and "Exchange" not in first.split("MapInArrow")[0]


@pytest.mark.parametrize(("size", "k", "piece"), [(5, 4, 8), (33, 9, 16), (33, 1, 16), (400, 40, 50), (100_000, 9, 64)])
def test_fasta_pieces_hold_every_window_once(spark, tmp_path, blocks_of, size, k, piece):
    rng = random.Random(size + k)
    sequences = ["".join(rng.choice("ACGTacgtN") for _ in range(n)) for n in (0, 3, 300, 1, 90, 700)]
    width = 13
    text = "".join(f">s{i} x>y\n" + "".join(f"{s[j : j + width]}\n" for j in range(0, len(s), width)) for i, s in enumerate(sequences))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">only\n" + sequences[4])
    blocks_of(size)
    rows = read_fasta_pieces(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], k, piece).collect()
    got = sorted((r["file"][-4:], r["record"], r["at"] + i, r["seq"][i : i + k]) for r in rows for i in range(len(r["seq"]) - k + 1))
    whole = [("a.fa", no, s) for no, s in enumerate(sequences)] + [("b.fa", 0, sequences[4])]
    assert got == sorted((f, no, i, s[i : i + k]) for f, no, s in whole for i in range(len(s) - k + 1))
    assert max(len(r["seq"]) for r in rows) <= max(piece + k - 1, 2 * k - 2)


def test_count_of_fasta_pieces_equals_that_of_whole_sequences(spark, tmp_path, blocks_of):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    (tmp_path / "a.fa").write_text(">s\n" + "".join(f"{seq[j : j + 60]}\n" for j in range(0, len(seq), 60)))
    blocks_of(500)
    config = O.CountConfig(k=40, min_count=1)
    whole = spark.createDataFrame([(seq,)], "seq string")
    assert sorted(O.count_fasta(spark, str(tmp_path / "a.fa"), config).df.collect()) == sorted(O.count(whole, config).df.collect())
    with pytest.raises(ValueError, match="homopolymers"):
        O.count_fasta(spark, str(tmp_path / "a.fa"), O.CountConfig(k=5, homopolymer=True))


def test_fasta_pieces_refuse_a_file_without_a_header(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="must begin with >"):
        read_fasta_pieces(spark, str(tmp_path / "a.fa"), 2).collect()
