from strandlake import operators as O
from strandlake.streaming import add_counts, counted


def test_batches_add_up(spark, tmp_path):
    """Counts of reads that arrive in two lots are those of all reads; a run without new reads adds nothing."""
    config, kind = O.CountConfig(k=3), "read_id long, seq string"
    lots = [[(0, "AACTGACA"), (1, None)], [(2, "AACTNNAAC")]]
    for n, lot in enumerate([*lots, []]):
        if lot:
            spark.createDataFrame(lot, kind).write.mode("append").parquet(f"{tmp_path}/reads")
        reads = spark.readStream.schema(kind).parquet(f"{tmp_path}/reads")
        add_counts(reads, config, f"{tmp_path}/counts", f"{tmp_path}/checkpoint").awaitTermination()
    want = O.totals(spark.createDataFrame([r for lot in lots for r in lot], kind), config)
    assert sorted(map(tuple, counted(spark, f"{tmp_path}/counts").collect())) == sorted(map(tuple, want.collect()))
