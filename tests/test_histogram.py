from pyspark.sql import functions as F

from strandlake import operators as O


def test_estimate_keeps_large_counts(spark):
    reads = spark.range(70_000).select(F.when(F.col("id") < 300, "AAC").otherwise("ACC").alias("seq"))
    got = lambda **limit: {r["count"]: r["n_kmers"] for r in O.estimated_histogram(reads, 3, digits=0, **limit).collect()}
    assert got() == {300: 1, 65_536: 1}
    assert got(max_count=255) == {255: 2}
