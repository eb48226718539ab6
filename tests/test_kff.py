import io
import random
import struct

import pyarrow as pa
import pytest

from strandlake import operators as O
from strandlake.operators.table import KmerMeta, KmerTable
from strandlake.sources.kff import _KffWriter, _sections, read_kff, write_kff

ACGT = 0b00_01_10_11
ODD = 0b10_00_11_01  # A is 2, C is 0, G is 3, T is 1


def bits(seq, encoding=ACGT):
    code = {c: encoding >> s & 3 for c, s in zip("ACGT", (6, 4, 2, 0))}
    value = 0
    for c in seq:
        value = value << 2 | code[c]
    return value.to_bytes(-(-len(seq) // 4), "big")


def variables(**values):
    return b"v" + struct.pack(">Q", len(values)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", x) for n, x in values.items())


def raw(rows, size, encoding=ACGT):
    return b"r" + struct.pack(">Q", len(rows)) + b"".join(bits(s, encoding) + c.to_bytes(size, "big") for s, c in rows)


def blocks(rows, size, most):
    """rows: (sequence, counters of its k-mers)."""
    head = (most.bit_length() + 7) // 8
    return b"r" + struct.pack(">Q", len(rows)) + b"".join(len(cs).to_bytes(head, "big") + bits(s) + b"".join(c.to_bytes(size, "big") for c in cs) for s, cs in rows)


def kff(sections, encoding=ACGT, unique=1, canonical=0, free=b"", footer=None, chained=False):
    out, places = b"KFF\1\0" + bytes([encoding, unique, canonical]) + struct.pack(">I", len(free)) + free, []
    for s in sections:
        places.append((s[:1], len(out)))
        out += s
    parts, nexts, first = [places], [0], len(out)
    if chained:
        parts = [places[:1], places[1:]]
        nexts = [len(out) + 17 + 9, 0]
    for part, then in zip(parts, nexts):
        end = len(out) + 17 + 9 * len(part)
        out += b"i" + struct.pack(">Q", len(part)) + b"".join(t + struct.pack(">q", p - end) for t, p in part) + struct.pack(">Q", then)
    values = {"first_index": first, **(footer or {})}
    size = len(variables(**values, footer_size=0))
    return out + variables(**values, footer_size=size) + b"KFF"


def rows(table):
    return sorted((r["kmer"], r["count"]) for r in table.df.collect())


@pytest.mark.parametrize("k", [1, 4, 11, 33, 130])
def test_round_trip(spark, tmp_path, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=300)) for _ in range(12)]
    table = O.count(spark.createDataFrame([(s,) for s in seqs], "seq string"), O.CountConfig(k=k, min_count=1, max_counter=200 if k > 5 else 60_000))
    table = KmerTable(table.df, KmerMeta(k, True, 1, 60_000, 2))
    for files, n in ((3, 3), (1, 1)):
        write_kff(table, str(tmp_path / "t"), files)
        assert 1 <= len(list((tmp_path / "t").glob("*.kff"))) <= n  # what stood there is gone
        assert not list((tmp_path / "t").glob("_*"))
        for piece in (5000, 1 << 26):
            back = read_kff(spark, str(tmp_path / "t"), piece)
            assert rows(back) == rows(table)
            assert (back.meta.k, back.meta.canonical, back.meta.min_count, back.meta.max_count, back.meta.counter_size) == (k, True, 1, 60_000, 2)


def test_cutoffs_empty_tables_and_wrong_rows(spark, tmp_path):
    df = spark.createDataFrame([("ACG", 1), ("AAA", 5), ("CCC", 300)], "kmer string, count long")
    write_kff(KmerTable(df, KmerMeta(3, min_count=2, max_count=299, counter_size=2)), str(tmp_path / "a"))
    assert rows(read_kff(spark, str(tmp_path / "a"))) == [("AAA", 5)]
    write_kff(KmerTable(df.where("count > 1000"), KmerMeta(3)), str(tmp_path / "e"), 1)
    for bad, meta in ((df, KmerMeta(3, counter_size=1)), (df, KmerMeta(4)), (df.selectExpr("replace(kmer, 'G', 'N') AS kmer", "count"), KmerMeta(3))):
        with pytest.raises(Exception, match="k-mers"):
            write_kff(KmerTable(bad, meta), str(tmp_path / "w"))
    assert not list((tmp_path / "w").rglob("*.kff"))  # nothing of a write that failed


def test_sections_of_many_batches():
    import strandlake.sources.kff as source

    kmers = sorted({"".join(random.Random(i).choices("ACGT", k=9)) for i in range(500)})
    writer = _KffWriter({"path": "/none", "k": "9", "canonical": "false", "counter_size": "1", "min_count": "1", "max_count": "255"}, True)
    out, old = io.BytesIO(), source.SECTION
    source.SECTION = 100
    try:
        writer._file(out, (pa.RecordBatch.from_pydict({"kmer": kmers[i : i + 40], "count": [7] * len(kmers[i : i + 40])}) for i in range(0, len(kmers), 40)))
    finally:
        source.SECTION = old
    section = lambda i: raw([(m, 7) for m in kmers[i : i + 120]], 1)
    listed = [variables(k=9, max=1, data_size=1, ordered=1), *(section(i) for i in range(0, len(kmers), 120))]
    about, sections = _sections(out, len(out.getvalue()))
    assert [s["blocks"] for s in sections] == [120, 120, 120, 120, len(kmers) - 480]
    assert (about["first_index"], about["max_count"], about["canonical"]) == (12 + sum(map(len, listed)), 255, 0)
    assert out.getvalue()[12:].startswith(b"".join(listed))


def test_scopes_blocks_encodings_and_indexes(spark, tmp_path):
    one = variables(k=5, max=1, data_size=2, ordered=1)
    many = variables(k=5, max=300, data_size=1)
    bare = variables(k=5, max=1, data_size=0)
    sections = [one, raw([("AAAAC", 700), ("ACGTA", 2)], 2), raw([("AAAAA", 9)], 2), many, blocks([("CCCCCTT", [1, 2, 3]), ("GGGTT", [255])], 1, 300), bare, raw([("TTTTT", 0)], 0)]
    want = sorted([("AAAAC", 700), ("ACGTA", 2), ("AAAAA", 9), ("CCCCC", 1), ("CCCCT", 2), ("CCCTT", 3), ("GGGTT", 255), ("TTTTT", 1)])
    for n, more in enumerate([{}, {"chained": True}, {"free": b"free text"}]):
        (tmp_path / f"{n}.kff").write_bytes(kff(sections, **more))
        for piece in (1, 1 << 26):
            assert rows(read_kff(spark, str(tmp_path / f"{n}.kff"), piece)) == want
    # The order of an ordered section is that of the codes; canonical k-mers become the smaller strand.
    odd = [one.replace(struct.pack(">Q", 5), struct.pack(">Q", 3), 1), raw([("CCA", 1), ("TTC", 4), ("ACC", 2), ("GAA", 3)][:3], 2, ODD)]
    (tmp_path / "odd.kff").write_bytes(kff(odd, encoding=ODD, canonical=1))
    assert rows(read_kff(spark, str(tmp_path / "odd.kff"))) == [("ACC", 2), ("CCA", 1), ("GAA", 4)]


def test_files_that_are_refused(spark, tmp_path):
    one = variables(k=4, max=1, data_size=1, ordered=1)
    good = kff([one, raw([("AAAA", 1), ("AACC", 2)], 1)])
    bad = {
        "not in order": kff([one, raw([("AACC", 1), ("AAAA", 2)], 1)]),
        "order": kff([one, raw([("AACC", 1), ("AACC", 2)], 1)]),
        "twice": kff([one, raw([("AACC", 1)], 1), raw([("AACC", 2)], 1)]),
        "twice: AACC": kff([one, raw([("AACC", 1)], 1), raw([("GGTT", 2)], 1)], canonical=1),
        "unique": kff([one, raw([("AACC", 1)], 1)], unique=0),
        "type b'm'": kff([one, b"m" + bytes(9)]),
        "lacks": kff([variables(k=4, max=1), raw([("AACC", 1)], 1)]),
        "marker at the end": good[:-1],
        "marker at the start": b"X" + good[1:],
        "same code": kff([one], encoding=0),
        "does not fit": good.replace(b"r" + struct.pack(">Q", 2), b"s" + struct.pack(">Q", 2)),
        "inside a section": kff([one, raw([("AAAA", 1)], 1).replace(struct.pack(">Q", 1), struct.pack(">Q", 10**6))]),
    }
    for n, (message, data) in enumerate(bad.items()):
        (tmp_path / f"{n}.kff").write_bytes(data)
        with pytest.raises(Exception, match=message):
            read_kff(spark, str(tmp_path / f"{n}.kff")).df.collect()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.kff").write_bytes(good)
    (tmp_path / "x" / "b.kff").write_bytes(kff([variables(k=5, max=1, data_size=1), raw([("AACCT", 1)], 1)]))
    with pytest.raises(ValueError, match="differ"):
        read_kff(spark, str(tmp_path / "x"))
