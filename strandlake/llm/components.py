"""Connected components by alternating large-star and small-star steps, all in DataFrames.

A group of any size is only ever joined with its own minimum, never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Self-loops and repeated edges are ignored; edges with a null end are dropped; an empty table gives an
    empty result. Ends when a round changes no edge, which takes about log(longest path) rounds.
    """
    kind = edges.schema["u"].dataType
    now = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    seen = _print_of(now)
    if seen[0]:
        for _ in range(max_rounds):
            then = written(_small_star(_large_star(now)), "edges")
            discard(now)
            now, last, seen = then, seen, _print_of(then)
            if seen == last:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .select(F.col("node").cast(kind), F.col("component").cast(kind))
    )
