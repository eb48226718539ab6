import random

import pytest
from pyspark.sql import functions as F

from strandlake import operators as O
from strandlake.operators.setops import MODES, OPERATIONS
from strandlake.plans import evaluate


def table(spark, seed, k=4):
    rng = random.Random(seed)
    rows = {"".join(rng.choices("ACGT", k=k)): rng.randrange(1, 9) for _ in range(120)}
    return O.KmerTable(spark.createDataFrame(list(rows.items()), "kmer string, count long"), O.KmerMeta(k, max_count=1000, counter_size=2)), rows


def rows_of(df):
    return sorted(map(tuple, df.select("kmer", "count").collect()))


def test_every_operation_and_mode_as_a_column(spark):
    (a, _), (b, _) = table(spark, 1), table(spark, 2)
    outputs = {f"{op} {mode}": (op, mode) for op in OPERATIONS for mode in ([None] if OPERATIONS[op] is None else [None, *MODES])}
    many = {}
    for r in O.simple_rows(a, b, outputs).collect():
        many.setdefault(r["name"], []).append((r["kmer"], r["count"]))
    for name, (op, mode) in outputs.items():
        assert sorted(many[name]) == rows_of(O.combine(a.df, b.df, op, mode)), name


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_pass(spark, tmp_path):
    (a, ra), (b, rb), (c, _) = table(spark, 1), table(spark, 2), table(spark, 3)
    outputs = {"i": ("intersect", None), "u": ("union", "max", {"min_count": 3, "max_counter": 5}), "s": ("kmers_subtract", None)}
    assert shuffles(O.simple_rows(a, b, outputs)) == 1
    # Three tables, one of them twice, and four operations: one shuffle.
    assert shuffles(evaluate("(a + min b) * max c - (a ~ c)", {"a": a, "b": b, "c": c}).df) == 1
    saved = O.save_many(a, b, outputs, str(tmp_path / "out"))
    assert rows_of(saved["i"].cut()) == sorted((x, min(ra[x], rb[x])) for x in ra.keys() & rb.keys())
    want = {x: max(ra.get(x, 0), rb.get(x, 0)) for x in ra.keys() | rb.keys()}
    assert rows_of(saved["u"].cut()) == sorted((x, min(n, 5)) for x, n in want.items() if n >= 3)
    assert rows_of(O.simple_many(a, b, outputs)["s"]) == sorted((x, n) for x, n in ra.items() if x not in rb)


@pytest.mark.parametrize("seed", range(4))
def test_expressions_equal_nested_joins(spark, seed):
    rng = random.Random(seed)
    tables = {n: table(spark, i)[0] for i, n in enumerate("abc")}
    signs = {"*": "intersect", "+": "union", "-": "kmers_subtract", "~": "counters_subtract"}

    def grow(depth):
        if depth == 0:
            n = rng.choice("abc")
            return n, tables[n].cut()
        (x, left), (y, right) = grow(rng.randrange(depth)), grow(depth - 1)
        sign = rng.choice("*+-~")
        mode = None if sign == "-" else rng.choice([None, *MODES])
        return f"({x} {sign} {mode or ''} {y})", O.combine(left, right, signs[sign], mode)

    text, want = grow(4)
    got = evaluate(text, tables, min_count=1, max_count=10**6, max_counter=10**6).df
    assert rows_of(got) == rows_of(want), text


def test_many_steps_stay_small(spark):
    tables = {n: table(spark, i)[0] for i, n in enumerate("abc")}
    got = evaluate(" + sum ".join(["a", "b", "c"] * 12), tables, min_count=1, max_count=10**6, max_counter=10**6).df
    assert got.agg(F.sum("count")).first()[0] == 12 * sum(t.df.agg(F.sum("count")).first()[0] for t in tables.values())
