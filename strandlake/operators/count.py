"""Counting k-mers: reads -> valid runs -> windows -> canonical -> group and count -> cutoffs -> clamp."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as K
from ..functions.exchange import counted_parts, super_blobs
from ..functions.packed import DENSE, packed_counts
from ..functions.packed import super_kmers as packed_super_kmers
from ..functions.sketch import sketched, solved
from ..sources.blocks import read_fasta_pieces
from .table import KmerMeta, KmerTable

MAX_K = 256
#: Largest cutoff and ceiling for k above 9.
LIMIT = (1 << 32) - 1
#: Parts of the super-k-mers of long k-mers for each shuffle partition.
PARTS = 8
#: K-mers of a read whose signatures are held at a time.
STRETCH = 1 << 18


@dataclass(frozen=True)
class CountConfig:
    """k; strand-specific or canonical; cutoffs, both inclusive; the counter's ceiling; homopolymer compression."""

    k: int = 25
    canonical: bool = True
    min_count: int = 2
    max_count: int = 1_000_000_000
    max_counter: int = 255
    homopolymer: bool = False
    signature_len: int = 9

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}")
        if self.min_count < 1 or self.max_count < self.min_count or self.max_counter < 1:
            raise ValueError("cutoffs must satisfy 1 <= min_count <= max_count and max_counter >= 1")
        for name in ("max_count", "max_counter"):
            if self.k > 9 and getattr(self, name) > LIMIT:
                warnings.warn(f"{name} is limited to {LIMIT} for k above 9", stacklevel=3)
                object.__setattr__(self, name, LIMIT)


def totals(reads: DataFrame, config: CountConfig, seq_col: str = "seq") -> DataFrame:
    """(kmer, count) of all k-mers, without cutoffs, by one shuffle.

    Up to DENSE symbols, partial counts are shuffled. Longer k-mers are mostly different, so super-k-mers are shuffled in packed
    bytes, in PARTS parts for each shuffle partition, and a part's k-mers are made and counted where it arrives. A sequence of any
    length is read in segments. Nulls have no k-mers.
    """
    k, seq = config.k, reads.select(F.col(seq_col).cast("string").alias("seq"))
    if k <= DENSE:
        each = seq.mapInArrow(packed_counts(k, config.canonical, config.homopolymer), "packed long, count long")
        return each.groupBy("packed").agg(F.sum("count").alias("count")).select(K.unpack(F.col("packed"), k).alias("kmer"), "count")
    parts = PARTS * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count_part = counted_parts(k, config.canonical)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_part(batches)

    blobs = seq.mapInArrow(super_blobs(k, parts, config.homopolymer), "part int, rows binary, counts binary")
    if k > K.PACKED:
        return blobs.groupBy("part").applyInArrow(counted, "kmer string, count long")
    return blobs.groupBy("part").applyInArrow(counted, "packed long, count long").select(K.unpack(F.col("packed"), k).alias("kmer"), "count")


def count(reads: DataFrame, config: CountConfig, seq_col: str = "seq") -> KmerTable:
    """The k-mer table of the reads: cutoffs on the exact counts, then the clamp."""
    kept = totals(reads, config, seq_col).where(F.col("count").between(config.min_count, config.max_count))
    size = 0 if config.max_counter == 1 else min(K.counter_bytes(config.max_count), K.counter_bytes(config.max_counter))
    meta = KmerMeta(config.k, config.canonical, config.min_count, config.max_count, size, config.signature_len)
    return KmerTable(kept.withColumn("count", F.least("count", F.lit(config.max_counter).cast("long"))), meta)


def count_fasta(spark: SparkSession, paths: str | list[str], config: CountConfig) -> KmerTable:
    """The k-mer table of FASTA files, whose sequences are read in pieces by many tasks, however long they are."""
    if config.homopolymer:
        raise ValueError("homopolymers need whole sequences: use read_fasta and count")
    return count(read_fasta_pieces(spark, paths, config.k, placed=False), config)


def statistics(reads: DataFrame, config: CountConfig, seq_col: str = "seq") -> DataFrame:
    """One row: k-mers below and above the cutoffs, different ones, those counted, all occurrences, and reads."""
    c = F.col("count")
    out = totals(reads, config, seq_col).agg(
        F.count_if(c < config.min_count).alias("n_below"), F.count_if(c > config.max_count).alias("n_above"), F.count("*").alias("n_unique"),
        F.count_if(c.between(config.min_count, config.max_count)).alias("n_unique_counted"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_total"),
    )
    return out.crossJoin(reads.agg(F.count("*").alias("n_reads")))  # one row each


def summary(reads: DataFrame, config: CountConfig, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """One row: the statistics, the number of super-k-mers, and all of them as one line of JSON."""
    # A k-mer shorter than a signature has none.
    rows = super_kmers(reads, config.k, config.signature_len, id_col, seq_col) if config.k >= config.signature_len else reads.limit(0)
    supers = rows.agg(F.count("*").alias("n_super_kmers"))
    out = statistics(reads, config, seq_col).crossJoin(supers)  # one row each
    names = {
        "n_below": "#k-mers_below_min_threshold", "n_above": "#k-mers_above_max_threshold", "n_unique": "#Unique_k-mers", "n_unique_counted": "#Unique_counted_k-mers",
        "n_total": "#Total no. of k-mers", "n_reads": "#Total_reads", "n_super_kmers": "#Total_super-k-mers",
    }
    return out.withColumn("json", F.to_json(F.struct(F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("Stats"))))


def kmers_of_kmers(table: KmerTable, k: int, canonical: bool = True) -> DataFrame:
    """Counts of the shorter k-mers of a table's k-mers; each k-mer is one read, whatever its counter."""
    return totals(table.df.select("kmer"), CountConfig(k=k, canonical=canonical), "kmer")


def signatures(reads: DataFrame, k: int, size: int, canonical: bool = True, seq_col: str = "seq") -> DataFrame:
    """(signature, n): occurrences of k-mers by signature, which is made once for each different k-mer."""
    counts = totals(reads, CountConfig(k=k, canonical=canonical), seq_col)
    return counts.groupBy(K.signature(F.col("kmer"), size).alias("signature")).agg(F.sum("count").alias("n"))


def super_kmers(reads: DataFrame, k: int, size: int, id_col: str = "read_id", seq_col: str = "seq", stretch: int = STRETCH) -> DataFrame:
    """(id, run_no, start, length, signature): maximal stretches of a run whose k-mers share a signature.

    start is 0-based in the run. Signatures are numbers made in Arrow batches, `stretch` k-mers of a read at a time, so the time is
    in proportion to the length; a read stays in its task and nothing is shuffled. Nulls and short runs have none.
    """
    if not 3 <= size <= min(k, K.PACKED):
        raise ValueError(f"a signature has from 3 to {min(k, K.PACKED)} symbols")
    kind = f"id {reads.schema[id_col].dataType.simpleString()}, run_no int, start int, length int, signature string"
    rows = reads.select(F.col(id_col).alias("id"), F.col(seq_col).cast("string").alias("seq")).mapInArrow(packed_super_kmers(k, size, stretch), kind)
    return rows.withColumnRenamed("id", id_col)


def estimated_histogram(reads: DataFrame, k: int, digits: int = 1, max_count: int = 65_536, seq_col: str = "seq") -> DataFrame:
    """(count, n_kmers) estimated from the canonical k-mers whose md5 starts with `digits` zeros, scaled up.

    Goes to the largest count; those over max_count are gathered in a last bin.
    """
    kept = totals(reads, CountConfig(k=k), seq_col).where(F.md5("kmer").startswith("0" * digits))
    counts = kept.select(F.least("count", F.lit(max_count).cast("long")).alias("count"))
    return counts.groupBy("count").agg((F.count("*") * 16**digits).alias("n_kmers"))


def sketch_histogram(reads: DataFrame, k: int, max_count: int = 1000, sample_bits: int = 7, slot_bits: int = 22, homopolymer: bool = False, seq_col: str = "seq") -> DataFrame:
    """(count, n_kmers double) estimated by a sketch: count 0 stands for all different k-mers, 1 to max_count for those of that count.

    Canonical k-mers are hashed and sampled in Arrow batches into two independent copies of 2**slot_bits counters, one of hashes whose
    top sample_bits are zero, one of those where they are one; tasks hand on sums of the counters they touched. How many counters hold each value
    is grouped, and each copy is solved for the histogram from these max_count numbers at most; results are the copies' mean,
    negative ones 0. The relative error of the sum is near sqrt(exp(m) - 1) / m / sqrt(2 ** (slot_bits + 1)) with m = F0 / 2 ** (slot_bits +
    sample_bits), which should not pass 5; a sketch whose counters are all taken is an error. No reads or no k-mers: all 0.
    """
    if not (1 <= sample_bits <= 32 and 1 <= slot_bits <= 30 and max_count >= 1):
        raise ValueError("sample_bits must be from 1 to 32, slot_bits from 1 to 30, max_count positive")
    each = reads.select(F.col(seq_col).cast("string").alias("seq")).mapInArrow(sketched(k, sample_bits, slot_bits, homopolymer), "packed long, count long")
    counters = each.groupBy("packed").agg(F.sum("count").alias("count"))
    # Counters over max_count are full all the same.
    values = counters.groupBy(F.shiftright("packed", slot_bits).cast("int").alias("copy"), F.least("count", F.lit(max_count + 1).cast("long")).alias("count")).agg(F.count("*").alias("n"))
    both = reads.sparkSession.createDataFrame([(0, 0, 0), (1, 0, 0)], "copy int, count long, n long").coalesce(1)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        filled = np.zeros(max_count + 1)
        rows = rows[rows["count"] > 0]
        filled[rows["count"].to_numpy() - 1] = rows["n"].to_numpy()
        total, found = solved(filled, 1 << slot_bits, sample_bits)
        return pd.DataFrame({"count": np.arange(max_count + 1), "n_kmers": np.concatenate([[total], found[:max_count]])})

    out = values.unionByName(both).groupBy("copy").applyInPandas(solve, "count long, n_kmers double")
    return out.groupBy("count").agg(F.greatest(F.avg("n_kmers"), F.lit(0.0)).alias("n_kmers"))
