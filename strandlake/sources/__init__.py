"""Reads from and to text files. gzip files are read by suffix; lists of paths are taken as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import read_bam as read_bam
from .blocks import read_fasta_pieces as read_fasta_pieces
from .blocks import read_fastq as read_fastq


def _text(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """(value, file, block, id) of each piece of the files; ids rise within a block of a file."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(paths if isinstance(paths, list) else [paths]).select("value", *where, F.monotonically_increasing_id().alias("id"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, seq) of FASTA, one-line or multi-line; line ends inside a sequence are dropped, empty sequences are kept.

    A record starts at a `>` that begins a line. A file that does not begin with `>` is an error when its rows are read. Plain
    files are read in splits.
    """
    pieces = _text(spark, paths, "\n>")
    # The piece at the very start of a file still has its `>`; one row per file; Spark decides by its size how to join.
    first = pieces.where("block = 0").groupBy("file").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    held = pieces.join(first, ["file", "id"], "left").where(F.col("first").isNull() | (F.trim(F.regexp_replace("value", r"[\r\n]", "")) != ""))
    wrong = F.raise_error(F.concat(F.lit("FASTA must begin with >: "), "file")).cast("string")
    body = F.when(F.col("first").isNull(), F.col("value")).when(F.col("value").startswith(">"), F.substr("value", F.lit(2))).otherwise(wrong)
    held = held.select(body.alias("value"))
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    return held.select(head.alias("header"), F.regexp_replace(F.substr("value", F.length(head) + 1), r"[\r\n]", "").alias("seq"))


def read_kmers(df: DataFrame) -> DataFrame:
    """A k-mer table as reads: every k-mer once."""
    return df.select(F.col("kmer").alias("header"), F.col("kmer").alias("seq"))


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a list file, one a line, empty ones left out."""
    return [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def numbered(reads: DataFrame) -> DataFrame:
    """reads with a read_id, unique but not gapless."""
    return reads.select(F.monotonically_increasing_id().alias("read_id"), *reads.columns)


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq")).write.text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    if "qual" not in reads.columns:
        raise ValueError("FASTQ needs qualities")
    reads.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def write_dump(table, path: str, ordered: bool = False) -> None:
    table.dump(ordered=ordered).write.text(path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    histogram.orderBy("count").select(F.concat_ws("\t", "count", "n_kmers")).write.text(path)
