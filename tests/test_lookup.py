import types

import numpy as np
import pyarrow as pa

from strandlake.functions import lookup


def test_counters_of_a_batch_are_handed_on_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(lookup, "SEGMENT", 1000)
    seqs = ["ACGTA" * 40, None, "", "ACG", "N" * 300, *["CCGTA" * 30] * 40, "ACGTACGT" * 500, None]
    table = types.SimpleNamespace(value=lookup.Sorted(lookup.key_array([b"ACGTA", b"CCGTA"], 5), np.array([7, 9]), 5, False))
    value = lambda _, x, __, t: np.concatenate([np.zeros(0, np.int64), *(c for _, c in t.counters(x))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs)], names=["id", "seq"])
    out = list(lookup.appended(1, "counters", pa.list_(pa.int64()), value, table)(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["id"], r["seq"]) for r in rows] == [*enumerate(seqs), *list(enumerate(seqs))[3:5]]
    hit = {"ACGTA": 7, "CCGTA": 9}
    for r in rows:
        assert r["counters"] == (None if r["seq"] is None else [hit.get(r["seq"][i : i + 5], 0) for i in range(len(r["seq"]) - 4)])
    # The lots before the longest read's hold no more than SEGMENT bytes and a read.
    sizes = [sum(len(r["seq"] or "") for r in b.to_pylist()) for b in out]
    assert max(x for x in sizes if x < 4000) < 1000 + 300 and len(out) > 6
