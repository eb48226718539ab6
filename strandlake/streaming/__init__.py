"""Counting reads that keep arriving: each micro-batch adds its counts, and a table sums them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.count import CountConfig, totals


def add_counts(reads: DataFrame, config: CountConfig, path: str, checkpoint: str, seq_col: str = "seq"):
    """Starts a stream that writes each batch's counts under batch=<n>; a batch run again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        totals(batch, config, seq_col).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far, over all batches."""
    return spark.read.parquet(path).groupBy("kmer").agg(F.sum("count").alias("count"))
