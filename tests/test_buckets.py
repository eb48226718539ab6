"""Tables saved in buckets: joined, grouped and looked up from their files without a shuffle."""

import random

import pytest

from strandlake import operators as O
from strandlake.plans import evaluate


@pytest.fixture
def tables(spark, tmp_path):
    rng, out = random.Random(5), {}
    for name in "abc":
        reads = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(400)),) for _ in range(3)], "seq string")
        table = O.count(reads, O.CountConfig(k=5, min_count=1, max_counter=1000))
        table.save(f"{tmp_path}/{name}", buckets=4)
        out[name] = (table, O.KmerTable.load(spark, f"{tmp_path}/{name}"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {n: spark.conf.get(n) for n in conf}
    for n, v in conf.items():
        spark.conf.set(n, v)
    yield out
    for n, v in old.items():
        spark.conf.set(n, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operation", ["intersect", "union", "kmers_subtract", "reverse_kmers_subtract", "counters_subtract", "reverse_counters_subtract"])
def test_set_operations_shuffle_nothing(tables, operation):
    (a, x), (b, y) = tables["a"], tables["b"]
    got = O.simple(x, y, operation)
    assert sorted(got.df.collect()) == sorted(O.simple(a, b, operation).df.collect())
    assert "Exchange" not in _plan(got.df)


def test_expressions_and_outputs_of_two_tables_shuffle_nothing(tables):
    stored, counted = {n: t[1] for n, t in tables.items()}, {n: t[0] for n, t in tables.items()}
    got = evaluate("(a + min b) * max a", stored).df
    assert sorted(got.collect()) == sorted(evaluate("(a + min b) * max a", counted).df.collect())
    assert "Exchange" not in _plan(got)
    three = "(a + min b) * max c"
    assert sorted(evaluate(three, stored).df.collect()) == sorted(evaluate(three, counted).df.collect())
    outputs = {"i": ("intersect", None), "u": ("union", None)}
    rows = O.simple_rows(stored["a"], stored["b"], outputs)
    assert sorted(rows.collect()) == sorted(O.simple_rows(counted["a"], counted["b"], outputs).collect())
    assert "Exchange" not in _plan(rows)


def test_lookup_reads_one_bucket_and_metadata_stay(spark, tables, tmp_path):
    counted, stored = tables["a"]
    assert stored.meta == counted.meta
    row = counted.df.first()
    assert stored.check(row["kmer"]) == row["count"]
    # Small files are a partition each.
    assert (stored.df.rdd.getNumPartitions(), stored.cut().where(f"kmer = '{row['kmer']}'").rdd.getNumPartitions()) == (4, 1)
    # A session whose catalog lacks the table declares it again; saving anew replaces the rows.
    for t in spark.catalog.listTables():
        if t.name.startswith("kmers_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = O.KmerTable.load(spark, f"{tmp_path}/a")
    assert sorted(again.df.collect()) == sorted(counted.df.collect())
    counted.reduce(3).save(f"{tmp_path}/a", buckets=2)
    assert sorted(O.KmerTable.load(spark, f"{tmp_path}/a").df.collect()) == sorted(counted.reduce(3).df.collect())
