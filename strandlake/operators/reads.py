"""Reads judged by the support of their k-mers: counter vectors, filter, trim, mask.

A table of at most SMALL_ROWS k-mers and SMALL_BYTES goes to all executors as packed keys in order; windows are then found by
binary search in Arrow batches, without a shuffle, and reads of any length are taken a stretch at a time. Larger tables are joined
on packed k-mers; there filter and trim need one number per read, masking the counters of a part of a read at a time, and only
`counters` gathers those of a whole read, which are its result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructType

from ..functions import lookup
from ..functions.packed import type_of
from .table import KmerTable

#: Bases of a read that are masked at a time.
PART = 1024
#: The largest table that is sent to all executors.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def small(table: KmerTable, rows: int | None = None):
    """The table as sorted arrays sent to all executors, None if it is larger than that; no more than the bound is collected."""
    k, spark = table.meta.k, table.df.sparkSession
    most = min(SMALL_ROWS if rows is None else rows, SMALL_BYTES // (k + 8))
    held = table.cut().select("kmer", F.col("count").cast("long").alias("count")).limit(most + 1).toArrow()
    if held.num_rows > most:
        return None
    kmers = [x.encode() for x in held.column("kmer").to_pylist()]
    return spark.sparkContext.broadcast(lookup.Sorted(lookup.key_array(kmers, k), held.column("count").to_numpy().astype(np.int64), k, table.meta.canonical))


def _with(reads: DataFrame, seq_col: str, name: str, kind: DataType, arrow: pa.DataType, value: Callable, table) -> DataFrame:
    """reads with one more column made of each sequence and a small table."""
    out = StructType([*reads.schema.fields]).add(name, kind)
    return reads.mapInArrow(lookup.appended(reads.columns.index(seq_col), name, arrow, value, table), out)


def _free(reads: DataFrame, name: str) -> str:
    while name in reads.columns:
        name = f"_{name}"
    return name


def positions(reads: DataFrame, table: KmerTable, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos, count): the counter at every 0-based place, 0 where the window is invalid or absent; by a join on packed k-mers."""
    k = table.meta.k
    kind = f"id {reads.schema[id_col].dataType.simpleString()}, pos long, valid boolean, packed {type_of(k)}"
    each = reads.select(F.col(id_col).alias("id"), F.col(seq_col).cast("string").alias("seq")).mapInArrow(lookup.places(k, table.meta.canonical), kind)
    keys = table.cut().select("kmer", F.col("count").cast("long").alias("count")).mapInArrow(lookup.packed_keys(k), f"packed {type_of(k)}, count long")
    found = each.where("valid").join(keys, "packed", "left").select("id", "pos", F.coalesce("count", F.lit(0)).alias("count"))
    # Invalid windows meet nothing, so they stay where they are.
    return found.unionByName(each.where("not valid").select("id", "pos", F.lit(0).cast("long").alias("count"))).select(F.col("id").alias(id_col), "pos", "count")


def _places(seq_col: str, k: int):
    return F.greatest(F.coalesce(F.length(seq_col), F.lit(0)) - k + 1, F.lit(0))


def _whole(n_min: int) -> None:
    if isinstance(n_min, bool) or not isinstance(n_min, int):
        raise ValueError("the limit must be an integer here")


def counters(reads: DataFrame, table: KmerTable, id_col: str = "read_id", seq_col: str = "seq", small_rows: int | None = None) -> DataFrame:
    """reads with an array of counters; empty for reads shorter than k. For a large table ids must be unique."""
    held = small(table, small_rows)
    none = F.array().cast("array<bigint>")
    if held:
        value = lambda _, x, __, t: np.concatenate([np.zeros(0, np.int64), *(c for _, c in t.counters(x))])
        out = _with(reads, seq_col, "counters", ArrayType(LongType()), pa.list_(pa.int64()), value, held)
        return out.withColumn("counters", F.coalesce("counters", none))
    rows = positions(reads, table, id_col, seq_col).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "count"))), lambda x: x["count"]).alias("counters"))
    return reads.join(rows, id_col, "left").withColumn("counters", F.coalesce("counters", none))


def filter_reads(reads: DataFrame, table: KmerTable, n_min: float = 2, n_max: float = 1_000_000_000, id_col: str = "read_id", seq_col: str = "seq", small_rows: int | None = None) -> DataFrame:
    """Keeps reads whose number of supported k-mers is within the limits: integers, or both fractions of all places."""
    fractions = [isinstance(x, float) for x in (n_min, n_max)]
    if any(fractions) and not (all(fractions) and 0 <= n_min <= 1 and 0 <= n_max <= 1):
        raise ValueError("limits must be two integers or two fractions from 0 to 1")
    hits, held = _free(reads, "_hits"), small(table, small_rows)
    if held:
        out = _with(reads, seq_col, hits, LongType(), pa.int64(), lambda _, x, __, t: lookup.hits(x, t), held)
    else:
        sums = positions(reads, table, id_col, seq_col).where("count > 0").groupBy(id_col).agg(F.count("*").alias(hits))
        out = reads.join(sums, id_col, "left")
    out = out.withColumn(hits, F.coalesce(hits, F.lit(0)))
    places = _places(seq_col, table.meta.k).cast("float")
    low, high = ((F.floor(F.lit(x).cast("float") * places) if all(fractions) else F.lit(x)) for x in (n_min, n_max))
    return out.where((F.col(hits) >= low) & (F.col(hits) <= high)).drop(hits)


def trim_reads(reads: DataFrame, table: KmerTable, n_min: int = 2, id_col: str = "read_id", seq_col: str = "seq", small_rows: int | None = None) -> DataFrame:
    """Cuts each read before its first k-mer with a counter under n_min; drops it if that is its first. For a large table ids must be unique."""
    _whole(n_min)
    bad, held = _free(reads, "_bad"), small(table, small_rows)
    if held:
        out = _with(reads, seq_col, bad, LongType(), pa.int64(), lambda _, x, __, t: lookup.first_below(x, t, n_min), held)
    else:
        first = positions(reads, table, id_col, seq_col).where(F.col("count") < n_min).groupBy(id_col).agg(F.min("pos").alias(bad))
        out = reads.join(first, id_col, "left")
    places = _places(seq_col, table.meta.k)
    good = F.coalesce(F.col(bad), places)
    out = out.where((places > 0) & (good > 0))
    keep = (good + table.meta.k - 1).cast("int")
    # The sequence's length is read before the sequence is cut.
    cut = {c: F.substr(F.col(c), F.lit(1), keep) for c in (seq_col, "qual") if c in reads.columns}
    return out.withColumns(cut).select(*reads.columns)


def mask_reads(reads: DataFrame, table: KmerTable, n_min: int = 2, id_col: str = "read_id", seq_col: str = "seq", small_rows: int | None = None) -> DataFrame:
    """Replaces by N every base that a k-mer with a counter under n_min covers; keeps all reads. For a large table ids must be unique.

    There, reads are masked in parts of PART bases, each with the windows that reach into it, and put together again.
    """
    _whole(n_min)
    k, held = table.meta.k, small(table, small_rows)
    done = _free(reads, "_masked")
    if held:
        value = lambda data, x, leads, t: lookup.masked(data, x, leads, t, n_min).decode("utf-8", "replace")
        out = _with(reads, seq_col, done, StringType(), pa.string(), value, held)
        return out.withColumn(seq_col, F.col(done)).select(*reads.columns)
    each = positions(reads, table, id_col, seq_col).withColumn("bad", F.col("count") < n_min)
    reach = F.array_distinct(F.array(F.floor(F.col("pos") / PART), F.floor((F.col("pos") + k - 1) / PART)))
    flags = each.select(id_col, "pos", "bad", F.explode(reach).alias("no")).groupBy(id_col, "no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "bad"))), lambda x: x["bad"]).alias("bad"))
    kind = f"id {reads.schema[id_col].dataType.simpleString()}, at long, part string"
    parts = reads.select(F.col(id_col).alias("id"), F.col(seq_col).cast("string").alias("seq")).mapInArrow(lookup.cut(PART), kind).withColumnRenamed("id", id_col)
    start = F.greatest(F.col("at") - k + 1, F.lit(0))

    def base(c, i):
        first = F.greatest(F.col("at") + i - k + 1, F.lit(0))
        cover = F.slice("bad", (first - start + 1).cast("int"), (F.col("at") + i - first + 1).cast("int"))
        return F.when(F.exists(cover, lambda x: x), F.lit("N")).otherwise(c)

    joined = parts.withColumn("no", F.floor(F.col("at") / PART)).join(flags, [id_col, "no"], "left")
    joined = joined.select(id_col, "at", F.when(F.col("bad").isNull(), F.col("part")).otherwise(F.array_join(F.transform(F.split("part", ""), base), "")).alias("part"))
    whole = joined.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias(done))
    return reads.join(whole, id_col, "left").withColumn(seq_col, F.coalesce(done, F.col(seq_col))).select(*reads.columns)
