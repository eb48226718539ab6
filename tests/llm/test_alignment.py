import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandlake.llm import alignment, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Whole texts by the tokenizers' own files, every link of every document."""
    a_tok, b_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_tok.encode_special_tokens = True
    # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order.
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in keep)}
    names = {i: t for t, i in a_tok.get_vocab().items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        groups = []
        if text:
            ia, ib = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            ta, tb = [bytes(alphabet[c] for c in names[i]) for i in ia], [b_bytes(i) for i in ib]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ends = lambda t: [sum(map(len, t[: n + 1])) for n in range(len(t))]
                ea, eb = ends(ta), ends(tb)
                low = 0
                for cut in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(ia, ea) if low < e <= cut], [i for i, e in zip(ib, eb) if low < e <= cut]))
                    low = cut
        docs.append(groups)
    count = Counter(p for g in docs for p in {(x, y) for a, b in g for x in a for y in b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, groups in enumerate(docs):
        links = [(x, y) for a, b in groups for x in a for y in b]
        sha = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return out


def odd_texts():
    rng = random.Random(4)
    words = ["the", "Überläufe", "naïve", "don't", "12345", "  ", "\n", "\n\n ", "\t", "a▁b", "▁", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "😀", "漢字かな", "שלום", "x\x1cy", "\xa0", "　", "é", "\x85", "...", "aaaaaaaaaaaaa", "https://ex.org/a?b=c", "\x00", "internationalization", "straße", "\r\n", "Ꮳ", "'ll", "''"]
    texts = ["".join(rng.choice([w, w, " " + w]) for w in rng.choices(words, k=rng.randrange(1, 30))) for _ in range(150)]
    plain = [w for w in words if "▁" not in w]
    texts += [" ".join(rng.choices(plain, k=rng.randrange(1, 60))) for _ in range(150)]
    return texts + [None, "", " ", "  ", "   ", "a ", "a  ", " a", "\n", "the the the", "the the the", "a▁", " x" * 3000, "ab" * 5000]


@pytest.mark.parametrize("sent", [alignment.SENT_GROUPS, 60, 0])
def test_against_brute_force(spark, sent, monkeypatch):
    texts = odd_texts()
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string, key int").repartition(3)
    _, ranks, pattern = queries.tokenizer_files()
    got = alignment.align(df, ranks, pattern, MODEL, sent=sent)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts)


def test_spans_and_emptied_dictionaries_change_nothing(spark):
    texts = odd_texts()
    encoders = alignment.Encoders(*queries.tokenizer_files()[1:], MODEL)
    for text in filter(None, texts):
        whole = alignment._document(text, alignment.Dictionary(encoders))
        try:
            kept, alignment.SPAN = alignment.SPAN, 7
            assert alignment._document(text, alignment.Dictionary(encoders)) == whole
        finally:
            alignment.SPAN = kept


def test_query_on_nothing_and_on_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "the same"), (3, "the same"), (3, "the same"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted(map(tuple, queries.op13_token_alignment(spark, f"{tmp_path}/a").collect()), key=repr)
    assert [r[1:7] for r in got] == [(2, 2, 2, 2, 2, 6), (2, 2, 2, 2, 2, 6), (0, 0, 0, 0, 0, 0), (2, 2, 2, 2, 2, 6)]
    assert {r[0] for r in got} == {None, 3, 4}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op13_token_alignment(spark, f"{tmp_path}/b").count() == 0
