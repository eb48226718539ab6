import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import ngram_join as N

NONE = np.zeros(0, np.uint64)


def scanned(rng):
    """Rows as _scan makes them: documents, then tokens, some of them twice in a set."""
    docs = pa.array([{f.name: ([i] if f.name == "sketch" else i) for f in N._DOC} for i in range(30)], N._DOC)
    keys, owns, salts = (rng.integers(0, top, 900) for top in (400, 40, 4))
    salts = np.where(keys % 10 == 0, salts + 1, 0).astype(np.int32)
    names = ["key", "own", "salt", "doc"]
    spread = N.signed(N.mix(np.arange(30, dtype=np.uint64)))
    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(30, np.int64)), pa.array(np.zeros(30, np.int32)), docs], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(keys - 200), pa.array(owns), pa.array(salts), pa.nulls(900, N._DOC)], names=names)


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_tokens_met_in_parts(held, monkeypatch):
    batches = [b for seed in range(3) for b in scanned(np.random.default_rng(seed))]
    monkeypatch.setattr(N, "_scan", lambda common: lambda _: iter(batches))
    monkeypatch.setattr(N, "HELD_TOKENS", held)
    sets = defaultdict(set)
    for r in (r for b in batches for r in b.to_pylist() if r["doc"] is None):
        sets[r["key"], r["salt"]].add(r["own"])
    want = [(key, own, N.MANY if salt else len(v)) for (key, salt), v in sets.items() if salt or len(v) > 1 for own in v]
    assert any(n == N.MANY for *_, n in want) and any(n < N.MANY for *_, n in want)
    parts = defaultdict(list)
    for out in N._dealt(NONE, 7)(iter([])):
        for i in range(out.num_rows):
            parts[out.column(0)[i].as_py()].append(out.slice(i, 1))
    got = [r for rows in parts.values() for out in N._met(iter(rows)) for r in out.to_pylist()]
    assert sorted((r["key"], r["own"], r["n"]) for r in got if r["doc"] is None) == sorted(want)
    assert sorted(r["doc"]["doc_id"] for r in got if r["doc"] is not None) == sorted([*range(30)] * 3)


def test_few_rows_are_shuffled_for_many_tokens(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for i in range(100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = N._shared(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), NONE)
        df.collect()
        node, written = [df._jdf.queryExecution().executedPlan()], []
        while node:
            x = node.pop()
            if x.nodeName() == "Exchange":
                written.append(x.metrics().get("shuffleRecordsWritten").get().value())
            node += [x.children().apply(i) for i in range(x.children().size())]
        # 100 documents, and a row for each part and task; a row for each token before.
        assert len(written) == 1 and written[0] <= 100 + 2 * 2 * 4 * N.PARTS
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sets_and_common_tokens_as_by_numpy():
    rng = np.random.default_rng(5)
    held = np.unique(rng.integers(0, 300, 90).astype(np.uint64))
    x = rng.integers(0, 400, 1000).astype(np.uint64)
    assert (N._among(x, held) == np.isin(x, held)).all()
    u = N.shingles(b"a b c d e a b c d e a b c d e f", N.HashCache())
    assert len(u) == 6 and (u == np.unique(u)).all()
