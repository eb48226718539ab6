"""Operators on reads and k-mer tables."""

from .count import CountConfig, count, count_fasta, estimated_histogram, kmers_of_kmers, signatures, sketch_histogram, statistics, summary, super_kmers, totals
from .reads import counters, filter_reads, mask_reads, trim_reads
from .setops import combine, combined, same, save_many, simple, simple_many, simple_rows, together
from .table import KmerMeta, KmerTable

__all__ = ["CountConfig", "KmerMeta", "KmerTable", "combine", "combined", "count", "count_fasta", "counters", "estimated_histogram", "filter_reads", "kmers_of_kmers", "mask_reads", "same", "save_many", "signatures", "simple", "simple_many", "simple_rows", "sketch_histogram", "statistics", "summary", "super_kmers", "together", "totals", "trim_reads"]
