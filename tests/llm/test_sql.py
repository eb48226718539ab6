import duckdb
import numpy as np
import pytest

from strandlake.llm import queries

WORDS = [f"w{i}" for i in range(300)]


def tables(spark, folder):
    rng = np.random.default_rng(8)
    base = " ".join(WORDS[:110])
    texts = [base, base.replace("w60 ", "New "), base.upper(), None, "", "  ", "one two", "ONE\ttwo", "ä ß " + " ".join(WORDS[20:90]), base + " " + " ".join(WORDS[150:160])]
    texts += [" ".join(rng.choice(WORDS, 90)) + " " + " ".join(WORDS[200:250]) for _ in range(4)]
    pages = ["é" * 60, "é" * 60, None, "", "short", "short", "x" * 100, "x" * 99, "x" * 99, "x" * 100]
    near = rng.normal(size=(12, 8))
    near[4:8] = near[:4] + 0.05 * rng.normal(size=(4, 8))
    vectors = [[float(v) for v in x] for x in near] + [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7]
    items = [" ".join(WORDS[30:45]), "Where do 3 boats and 4 kg of rope go", "No match at all in any of these texts"]
    texts += ["so where do 5 boats and 6 kg of rope go then", "Where do 3 boats and 3 kg of rope go"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, v, None if i == 3 else i % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    tables(spark, d)
    return d


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
