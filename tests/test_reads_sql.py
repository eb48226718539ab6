"""The read queries, and the KFF round trip, on all runs of all documents, against their SQL in DuckDB."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["superkmers", "read_trim", "read_hard_mask", "kff_round_trip"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = [tuple(r) for r in cur.fetchall()]
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_no_letter_is_left_out(spark):
    out = entry.queries()["superkmers"](spark, SF)
    assert out.selectExpr("sum(length - 10)").first()[0] == 13711
