"""Set algebra of k-mer tables, with a rule that combines counters.

One operation on two tables is a join on the k-mer. Several operations, or an expression over many tables, read every table once:
all are put together by one grouping, a column each, and every operation is a column made of two others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .table import KmerMeta, KmerTable

MODES = {
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "sum": lambda a, b: a + b,
    "diff": lambda a, b: F.greatest(a - b, F.lit(0).cast("long")),
    "left": lambda a, b: a,
    "right": lambda a, b: b,
}
#: Operation -> default mode; None takes no mode.
OPERATIONS = {"intersect": "min", "union": "sum", "kmers_subtract": None, "counters_subtract": "diff", "reverse_kmers_subtract": None, "reverse_counters_subtract": "diff"}


def combine(a: DataFrame, b: DataFrame, operation: str, mode: str | None = None) -> DataFrame:
    """(kmer, count) of one operation; results of 0 or less are dropped.

    The narrowest join is used: inner, full outer, left anti or left.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    if OPERATIONS[operation] is None and mode is not None:
        raise ValueError(f"{operation} takes no counter mode")
    mode = mode or OPERATIONS[operation]
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown counter mode {mode!r}")
    if operation.startswith("reverse_"):
        return combine(b, a, operation.removeprefix("reverse_"), mode)
    left, right = a.select("kmer", F.col("count").alias("a")), b.select("kmer", F.col("count").alias("b"))
    if operation == "kmers_subtract":
        return left.join(right, "kmer", "left_anti").select("kmer", F.col("a").alias("count"))
    both: Column = MODES[mode](F.col("a"), F.col("b"))
    if operation == "intersect":
        out = left.join(right, "kmer").select("kmer", both.alias("count"))
    elif operation == "union" and mode == "sum":
        out = a.select("kmer", "count").unionByName(b.select("kmer", "count")).groupBy("kmer").agg(F.sum("count").alias("count"))
    else:
        joined = left.join(right, "kmer", "full" if operation == "union" else "left")
        out = joined.select("kmer", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(both).alias("count"))
    return out.where("count > 0")


def joint_meta(tables: list[KmerTable]) -> KmerMeta:
    """What the result of an operation on tables defaults to; their k must agree."""
    metas = [t.meta for t in tables]
    if len({m.k for m in metas}) != 1:
        raise ValueError("tables of different k")
    return KmerMeta(metas[0].k, all(m.canonical for m in metas), min(m.min_count for m in metas), max(m.max_count for m in metas), max(m.counter_size for m in metas), metas[0].signature_len)


def _limits(meta: KmerMeta, min_count: int | None = None, max_count: int | None = None, max_counter: int | None = None) -> tuple[int, int, int]:
    return min_count or meta.min_count, max_count or meta.max_count, max_counter or (1 << (8 * max(1, meta.counter_size))) - 1


def limited(df: DataFrame, meta: KmerMeta, min_count: int | None = None, max_count: int | None = None, max_counter: int | None = None) -> KmerTable:
    """Output cutoffs, then the ceiling, by default what the widest input counter holds."""
    low, high, top = _limits(meta, min_count, max_count, max_counter)
    kept = df.where(F.col("count").between(low, high)).withColumn("count", F.least("count", F.lit(top).cast("long")))
    return KmerTable(kept, KmerMeta(meta.k, meta.canonical, low, high, meta.counter_size, meta.signature_len))


def simple(a: KmerTable, b: KmerTable, operation: str, mode: str | None = None, **limits: int) -> KmerTable:
    return limited(combine(a.cut(), b.cut(), operation, mode), joint_meta([a, b]), **limits)


def together(tables: dict[str, KmerTable]) -> DataFrame:
    """(kmer, a column for each table): the counters of every k-mer within the tables' cutoffs, null where a table lacks it.

    One shuffle for all; two tables saved in equally many buckets are joined from their files without one.
    """
    kinds = {t.buckets for t in tables.values()}
    if len(tables) == 2 and len(kinds) == 1 and None not in kinds:
        left, right = (t.cut().select("kmer", F.col("count").cast("long").alias(n)) for n, t in tables.items())
        return left.join(right, "kmer", "full")
    rows = None
    for name, table in tables.items():
        one = table.cut().select("kmer", *((F.col("count") if n == name else F.lit(None)).cast("long").alias(n) for n in tables))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("kmer").agg(*(F.max(n).alias(n) for n in tables))


def combined(operation: str, mode: str | None, x: Column, y: Column) -> Column:
    """The counter of one operation on two columns of counters, null where the result lacks the k-mer."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    if OPERATIONS[operation] is None and mode is not None:
        raise ValueError(f"{operation} takes no counter mode")
    if operation.startswith("reverse_"):
        return combined(operation.removeprefix("reverse_"), mode, y, x)
    mode = mode or OPERATIONS[operation]
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown counter mode {mode!r}")
    if operation == "kmers_subtract":
        return F.when(y.isNull(), x)
    both = MODES[mode](x, y)
    # greatest and least pass over nulls, so a result of both needs both.
    both = F.when(x.isNotNull() & y.isNotNull() & (both > 0), both)
    if operation == "intersect":
        return both
    alone = F.when(y.isNull(), x) if operation == "counters_subtract" else F.when(y.isNull(), x).when(x.isNull(), y)
    return alone.otherwise(both)


def simple_rows(a: KmerTable, b: KmerTable, outputs: dict[str, tuple]) -> DataFrame:
    """(name, kmer, count) of several operations in one pass: name -> (operation, mode), or with a dict of output limits behind."""
    meta = joint_meta([a, b])
    each = []
    for name, (operation, mode, *limits) in outputs.items():
        n = combined(operation, mode, F.col("a"), F.col("b"))
        if limits:
            low, high, top = _limits(meta, **limits[0])
            n = F.when(n.between(low, high), F.least(n, F.lit(top).cast("long")))
        each.append(F.struct(F.lit(name).alias("name"), n.alias("count")))
    rows = together({"a": a, "b": b}).select("kmer", F.explode(F.array(*each)).alias("x"))
    return rows.where("x.count is not null").select("x.name", "kmer", "x.count")


def simple_many(a: KmerTable, b: KmerTable, outputs: dict[str, tuple]) -> dict[str, DataFrame]:
    """The outputs of simple_rows by name. Each is a plan of its own; save_many writes all of them in one pass."""
    rows = simple_rows(a, b, outputs)
    return {name: rows.where(F.col("name") == name).select("kmer", "count") for name in outputs}


def save_many(a: KmerTable, b: KmerTable, outputs: dict[str, tuple], path: str) -> dict[str, KmerTable]:
    """Writes all outputs in one pass, a folder for each, and returns the stored tables."""
    meta = joint_meta([a, b])
    simple_rows(a, b, outputs).write.mode("overwrite").partitionBy("name").parquet(path)
    rows = a.df.sparkSession.read.schema("kmer string, count long, name string").parquet(path)
    out = {}
    for name, (_, _, *limits) in outputs.items():
        low, high, _top = _limits(meta, **(limits[0] if limits else {}))
        kept = KmerMeta(meta.k, meta.canonical, low if limits else 1, high if limits else (1 << 63) - 1, meta.counter_size, meta.signature_len)
        out[name] = KmerTable(rows.where(F.col("name") == name).select("kmer", "count"), kept)
    return out


def same(a: KmerTable, b: KmerTable) -> bool:
    """Whether both hold the same k-mers with the same counters, within their own cutoffs."""
    pair = a.cut().select("kmer", F.col("count").alias("a")).join(b.cut().select("kmer", F.col("count").alias("b")), "kmer", "full")
    return pair.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
