"""The registered queries that no SQL covers, against their contracts on a whole small table."""

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


def folds(ids, n):
    return [crc32(str(i).encode()) % n for i in ids]


def text(x):
    return x if isinstance(x, str) else ""


def test_language(spark, docs):
    out = QUERIES["op1_language_id"](spark, SF).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index) and out["score"].between(0, 1).all()
    assert out["held_out"].tolist() == [f == 2 for f in folds(out.index, 4)]
    learned = set(docs["lang"][[f != 2 for f in folds(docs.index, 4)]].dropna())
    lettered = docs["text"].map(lambda t: any(c.isalpha() for c in text(t))).reindex(out.index)
    assert set(out["lang_pred"]) <= learned | {"und"} and (~lettered <= (out["lang_pred"] == "und")).all()
    asked = out[out["held_out"] & lettered & docs["lang"].reindex(out.index).notna()]
    assert len(asked) > 20 and (asked["lang_pred"] == docs["lang"].reindex(asked.index)).mean() >= 0.95


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(text(t), add_special_tokens=False).ids, 0] for i, t in docs["text"].items()}
    out = QUERIES["op2_packing"](spark, SF).toPandas()
    for doc, part in out.groupby("doc_id"):
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() == len(ids[doc]) and (part["doc_tokens"] == len(ids[doc])).all()
        for r in part.itertuples():
            assert r.ids_crc32 == crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes())
    assert set(out["doc_id"]) == set(ids)
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 1024
    assert sum(map(len, ids.values())) >= 0.95 * 1024 * out["sequence_id"].nunique()


def test_pii(spark, docs):
    out = QUERIES["op3_pii_surrogates"](spark, SF).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    address = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    before = {a for t in docs["text"] for a in address.findall(text(t))}
    after = {a for t in out["text"] for a in address.findall(text(t))}
    assert before and not before & after and len(before) == len(after)  # replaced, each by one of its own
    changed = out["text"].map(text) != docs["text"].reindex(out.index).map(text)
    assert (changed == (out["n_entities"].fillna(0) > 0)).all()


def test_quality(spark):
    larger = "/root/testdata/sf0.01"  # the smallest table holds three held-out labels of 0
    docs = pd.read_parquet(f"{larger}/documents.parquet").set_index("doc_id")
    out = QUERIES["op4_quality"](spark, larger).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index) and out["score"].between(0, 1).all()
    assert out["held_out"].tolist() == [f == 0 for f in folds(out.index, 5)] and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    labels = pd.read_parquet(f"{larger}/labels.parquet").set_index("doc_id")["quality"].dropna()
    asked = out[out["held_out"] & out.index.isin(labels.index)]
    good, bad = (asked["score"][labels.reindex(asked.index) == v].to_numpy() for v in (1, 0))
    assert len(good) > 3 and len(bad) > 3 and (good[:, None] > bad[None]).mean() >= 0.9


def test_urls(spark):
    """Host, path, rule and ruled verdict by plain string search."""
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    out = QUERIES["op6_url_filter"](spark, SF).toPandas().set_index("page_id")
    assert sorted(out.index) == sorted(pages.index) and set(out["verdict"]) <= {"allow", "block"}
    ruled = 0
    for page, r in out.iterrows():
        host, path, rule = judged(pages["url"][page])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        ruled += rule is not None
        assert rule is None or r["verdict"] == rules[rule]
    assert 0 < ruled < len(out)
