"""Each stage of the pipeline on small tables, against brute force or planted cases."""

import re

import numpy as np
import pytest

import corpus_pipeline
from strandlake.llm import decontaminate, packing
from strandlake.llm.queries import tokenizer_files

WORDS = [f"w{i}" for i in range(300)]
KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "r", 0.5) for i, t, lang in rows], KIND)


def test_language_stage(spark):
    rng = np.random.default_rng(2)
    text = lambda a: " ".join("".join(rng.choice(list(a), 6)) for _ in range(30))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz"), "pq"[i % 2]) for i in range(80)]
    odd = [(100, None, None), (101, "", "p"), (102, "12 !!", None), (5, "abc fed", None), (None, "uvw zyx", None)]
    df = docs(spark, rows + odd)
    out = corpus_pipeline.language_stage(spark, df, "")
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns and sorted(kept, key=str) == sorted([*range(80), 5, None], key=str)
    assert corpus_pipeline.language_stage(spark, df.limit(0), "").count() == 0


def test_near_duplicate_stage_with_unique_ids(spark):
    base = " ".join(WORDS[:80])
    rows = [(4, base, None), (2, base.replace("w40 ", "x "), None), (9, base.upper(), None), (1, " ".join(WORDS[100:150]), None), (3, None, None), (5, "", None)]
    df = docs(spark, rows)
    out = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 5]
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id(spark):
    base, other, third = " ".join(WORDS[:80]), " ".join(WORDS[100:180]), " ".join(WORDS[200:280])
    rows = [(1, base, "a"), (1, other, "b"), (1, base, "c"), (2, other.replace("w140 ", "x "), "d"), (None, third, "e"), (7, third, "f"), (None, base, "g"), (None, None, "h"), (None, "unlike all", "i")]
    out = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "").collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    assert got == sorted([(1, base), (1, other), (7, third), (None, None), (None, "unlike all")], key=str)


def test_decontamination_stage(spark, tmp_path, monkeypatch):
    item = "if a train runs 60 km in 2 hours how far does it run in 5 hours"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = item.replace("60", "80").replace("2 ", "4 ")
    rows = [(1, f"so {item} then", None), (2, f"so {other} then", None), (2, "clean text of no note", None), (None, item, None), (3, None, None), (4, "", None)]
    df = docs(spark, rows).withColumnRenamed("score", "text_hash").withColumnRenamed("source", "item_id")
    out = corpus_pipeline.decontamination_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and [(r["doc_id"], r["text"]) for r in out.orderBy("doc_id").collect()] == [(2, "clean text of no note"), (3, None), (4, "")]
    assert decontaminate.clean(df.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_FOUND", 0)  # the join beyond it
    assert sorted(r["text"] or "" for r in corpus_pipeline.decontamination_stage(spark, df, str(tmp_path)).collect()) == ["", "", "clean text of no note"]


def test_pii_stage(spark):
    rows = [(1, "mail a@b.com now", None), (1, "nothing", None), (None, None, None), (2, "", None)]
    out = corpus_pipeline.pii_stage(spark, docs(spark, rows), "").collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out if r["text"])
    assert sum("a@b.com" in (r["text"] or "") for r in out) == 0 and sum(r["text"] == "nothing" for r in out) == 1


def test_packing_stage_against_the_tokenizer(spark):
    """Ids of the tokenizer file, every id once, gapless sequences; nulls, long and odd texts, repeated rows, clashing names."""
    from tokenizers import Tokenizer

    import zlib

    files = tokenizer_files()
    tok = Tokenizer.from_file(files[0])
    rng = np.random.default_rng(6)
    odd = ["a\u00a0b\u2003c\u3000d", "x\x1c\x1dy  \t\n\r\n z", "caf\u0301e \u200b\u200d😀👩‍👩‍👧", "<|endoftext|> in <|endoftext|>", "漢字かな交じり文", "  ", "\x00\x01", "it's 1234567 I'LL", "عربي עברית"]
    rows = [(i, "".join(rng.choice(list("ab c\n.,é漢 1'"), int(rng.integers(0, 400)))), None) for i in range(60)] + list(zip(range(100, 100 + len(odd)), odd, [None] * len(odd)))
    rows += [(200, None, None), (201, "", None), (None, "null id", None), (202, " ".join(rng.choice(WORDS, 9000)), None), (203, "same", None), (203, "same", None), (204, "q" * 50_000, None)]
    df = docs(spark, rows).withColumnRenamed("source", "length").withColumnRenamed("lang", "bucket")
    out = corpus_pipeline.packing_stage(spark, df, "").collect()
    want = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((-1 if i is None else i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in rows) if len(ids) <= 1024)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["length"], r["ids_crc32"]) for r in out if r["doc_tokens"] <= 1024) == want
    long = [*tok.encode(rows[-4][1], add_special_tokens=False).ids, 0]
    cut = sorted((r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == 202)
    assert cut == [(a, min(1024, len(long) - a), zlib.crc32(np.array(long[a : a + 1024], "<u4").tobytes())) for a in range(0, len(long), 1024)]
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(by_sequence) == set(range(len(by_sequence)))
    assert packing.pack(df.limit(0), *files).count() == 0


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII surrogates", "packing"]
    assert all(re.match(r"\w", n) for n, _ in corpus_pipeline.STAGES)


@pytest.mark.parametrize("size", [64])
def test_run_keeps_what_stages_keep(spark, tmp_path, size):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abcdef" if i % 2 else "uvwxyz"), 5)) for _ in range(size)), "pq"[i % 2]) for i in range(40)]
    rows += [(50, rows[3][1], None), (51, "123 456", None), (52, None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[8][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(40)) - {8}
