import io
import random
import struct
import zlib

import pandas as pd
import pytest
from pyspark.errors import PythonException

from strandlake.sources import bam as bam_source
from strandlake.sources import read_bam
from strandlake.sources.bam import BLOCK, _first, _mended, _records, _splits

CODES = "=ACMGRSVTWYHKDBN"


def record(name, seq, qual=None, flag=0, cigar=1, tail=b""):
    codes = [CODES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body = struct.pack("<iiBBHHHiiii", 0, 7, len(name) + 1, 30, 0, cigar, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + bytes(4 * cigar) + packed
    body += (b"\xff" * len(seq) if qual is None else bytes(ord(q) - 33 for q in qual)) + tail
    return struct.pack("<i", len(body)) + body


def blocks(data, sizes):
    out, at = b"", 0
    while at < len(data):
        part = data[at : at + next(sizes)]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HccHH", 6, b"B", b"C", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
        at += len(part)
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam(records, sizes):
    text = b"@HD\tVN:1.6\n"
    return blocks(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 9) + b"".join(records), sizes)


def sizes(rng, most):
    while True:
        yield rng.randint(1, most)


def read(spark, path, **more):
    return sorted((tuple(r) for r in read_bam(spark, path, **more).collect()), key=repr)


@pytest.mark.parametrize("most", [700, 60_000])
def test_reads_in_splits(spark, tmp_path, most):
    rng = random.Random(most)
    want, records = [], []
    for i in range(2500):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 20, 100, 151, 3000 if i % 500 == 0 else 80])))
        qual = "".join(chr(33 + rng.randrange(60)) for _ in seq) if seq and i % 7 else None
        flag = rng.choice([0, 0, 16, 256, 2048])
        records.append(record(f"r{i}", seq, qual, flag, rng.randrange(4), rng.randbytes(rng.randrange(60))))
        if not flag & 0x900:
            want.append((f"r{i}", seq, qual))
    data = bam(records, sizes(rng, most))
    (tmp_path / "a.bam").write_bytes(data)
    assert len(data) > 3 << 16
    assert read(spark, str(tmp_path / "a.bam"), split_bytes=1 << 16) == read(spark, str(tmp_path / "a.bam")) == sorted(want, key=repr)


def test_what_looks_like_records_is_none(spark, tmp_path):
    rng = random.Random(3)
    noise = lambda i: record(f"fake{i}", "".join(rng.choices("ACGT", k=300)), None, 0, 0, rng.randbytes(200))
    inner = b"".join(noise(i) for i in range(900))
    records = [record("a", "ACGT"), record("b", "GGT", "III", 0, 0, b"XXBC" + struct.pack("<i", len(inner)) + inner), record("c", "TTA")]
    (tmp_path / "b.bam").write_bytes(bam(records, sizes(rng, 5000)))
    data = (tmp_path / "b.bam").read_bytes()
    file = io.BytesIO(data)
    firsts = [_first(file, len(data), k, k + BLOCK) for k in range(0, len(data), BLOCK)]
    assert any(x and x not in {at for at, _ in _records(file, len(data), firsts[0], len(data))} for x in firsts)  # a wrong guess
    assert read(spark, str(tmp_path / "b.bam"), split_bytes=1 << 16) == [("a", "ACGT", None), ("b", "GGT", "III"), ("c", "TTA", None)]


def test_strands_empty_and_damaged_files(spark, tmp_path):
    one = [record("r", "AACGN", "ABCDE", 16), record("f", "AAC", None)]
    (tmp_path / "c.bam").write_bytes(bam(one, iter([10_000])))
    assert read(spark, str(tmp_path / "c.bam")) == [("f", "AAC", None), ("r", "AACGN", "ABCDE")]
    assert read(spark, str(tmp_path / "c.bam"), forward=True) == [("f", "AAC", None), ("r", "NCGTT", "EDCBA")]
    (tmp_path / "d.bam").write_bytes(bam([], iter([10_000])))
    assert read(spark, str(tmp_path / "d.bam")) == []
    for n, wrong in enumerate([b"no BAM file", blocks(b"BAD\1" + bytes(40), iter([99])), blocks(b"BAM\1" + bytes([200, 0, 0, 0]), iter([99])), bam([one[0], one[1][:-3]], iter([10_000]))]):
        (tmp_path / f"w{n}.bam").write_bytes(wrong)
        with pytest.raises(PythonException):
            read(spark, str(tmp_path / f"w{n}.bam"))


def test_only_wrong_splits_are_walked_again(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    body = lambda name: record(name, "".join(rng.choices("ACGT", k=300)), None, 0, 0, rng.randbytes(200))
    inner = b"".join(body(f"fake{i}") for i in range(400))
    planted = record("b", "GGT", "III", 0, 0, b"XXBC" + struct.pack("<i", len(inner)) + inner)
    records = [body(f"l{i}") for i in range(700)] + [planted] + [body(f"r{i}") for i in range(700)]
    path = tmp_path / "m.bam"
    path.write_bytes(bam(records, sizes(rng, 5000)))
    n = path.stat().st_size
    whole = pd.DataFrame([(str(path), n, k, min(n, k + BLOCK)) for k in range(0, n, BLOCK)], columns=["path", "length", "start", "end"])
    marks = pd.concat(_splits([whole]))
    walked, end = [], bam_source._end
    monkeypatch.setattr(bam_source, "_end", lambda *a: walked.append(a) or end(*a))
    held = _mended(marks)
    assert 0 < len(walked) < len(held) - 4  # the splits before and behind the planted record are taken as they are
    with open(path, "rb") as file:
        places = [at for at, _ in _records(file, n, int(held["first"][0]), n)]
    starts = [min(p for p in places if p >> 16 >= k) for k in range(0, n, BLOCK) if any(k <= p >> 16 < k + BLOCK for p in places)]
    assert held["first"].tolist() == starts
    want = sorted([f"l{i}" for i in range(700)] + ["b"] + [f"r{i}" for i in range(700)])
    assert [r[0] for r in read(spark, str(path), split_bytes=BLOCK)] == want
