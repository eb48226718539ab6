"""Resharding by minimum-cost flow: the fewest bytes are moved to bring shards to new capacities, and only affected files are rewritten.

A sharded table lies in a folder as blocks of bounded size, one folder each; a block is what is kept or moved. From the sizes of
the old shards and the capacities of the new ones (a number a shard, whatever the table), a flow of least cost says how many
bytes stay and how many go from which shard to which. The flow is laid along the blocks of each old shard; blocks that lie
across the end of a stretch are split by running sums of their rows. Blocks that stay whole are never read again.
"""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructType

from .common import shared_dir, tune, written

#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Bytes of a block, and how many blocks a shard has at least.
BLOCK_BYTES, LEAST_BLOCKS = 256 << 20, 8


def min_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a greatest flow of least cost, by shortest augmenting paths."""
    room, heads, out = [], [], {}
    for a, b, capacity, cost in edges:
        out.setdefault(a, []).append(len(heads))
        out.setdefault(b, []).append(len(heads) + 1)
        heads += [(b, cost), (a, -cost)]
        room += [capacity, 0]
    while True:
        dist, via, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            node = queue.popleft()
            queued.discard(node)
            for e in out.get(node, ()):
                to, cost = heads[e]
                if room[e] > 0 and dist[node] + cost < dist.get(to, float("inf")):
                    dist[to], via[to] = dist[node] + cost, e
                    if to not in queued:
                        queue.append(to)
                        queued.add(to)
        if sink not in dist:
            return room[1::2]
        path, node = [], sink
        while node != source:
            path.append(via[node])
            node = heads[via[node] ^ 1][0]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """(old shard, new shard) -> bytes, what stays included: the fewest bytes change their shard.

    A byte may stay in the shard of its number at no cost or leave through a hub at a cost of 1. What leaves is paired with what
    is free in order, which needs the fewest stretches.
    """
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities hold less than the shards")
    hub, source, sink = n + m, n + m + 1, n + m + 2
    total = sum(sizes)
    edges = [(source, i, sizes[i], 0) for i in range(n)] + [(n + j, sink, capacities[j], 0) for j in range(m)]
    stay = [(i, n + i, total, 0) for i in range(min(n, m))]
    leave, come = [(i, hub, total, 1) for i in range(n)], [(hub, n + j, total, 0) for j in range(m)]
    flow = min_cost_flow(edges + stay + leave + come, source, sink)[len(edges) :]
    out = {(i, i): x for i, x in enumerate(flow[: len(stay)]) if x}
    gone = [[i, x] for i, x in enumerate(flow[len(stay) : len(stay) + n]) if x]
    for j, free in enumerate(flow[len(stay) + n :]):
        while free:
            x = min(free, gone[0][1])
            out[gone[0][0], j] = out.get((gone[0][0], j), 0) + x
            free -= x
            gone[0][1] -= x
            if not gone[0][1]:
                gone.pop(0)
    return out


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass(frozen=True)
class Shards:
    """A sharded table: the folder, how many shards, its live blocks (generation, shard, block, n, bytes), the type of its rows."""

    folder: str
    count: int
    generations: int
    blocks: DataFrame
    rows_type: DataType

    def rows(self, blocks: DataFrame | None = None) -> DataFrame:
        """(shard, block, size, row) of the live blocks or of those given; row holds the columns of the table."""
        spark, out = self.blocks.sparkSession, None
        schema = StructType().add("size", LongType()).add("row", self.rows_type).add("shard", IntegerType()).add("block", StringType())
        for g in range(self.generations):
            live = (self.blocks if blocks is None else blocks).where(F.col("generation") == g).select("shard", "block")
            one = spark.read.schema(schema).parquet(f"{self.folder}/g{g}").join(live, ["shard", "block"], "left_semi")
            one = one.select("shard", "block", "size", "row", F.lit(g).alias("generation"))
            out = one if out is None else out.unionByName(one)
        return out

    def sizes(self) -> list[int]:
        """Bytes by shard; one row a shard is collected."""
        held = {r["shard"]: r["bytes"] for r in self.blocks.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
        return [held.get(i, 0) for i in range(self.count)]


def _measured(rows: DataFrame, generation: int) -> DataFrame:
    sums = rows.groupBy("shard", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sums.select(F.lit(generation).alias("generation"), "shard", "block", "n", "bytes")


def _write(rows: DataFrame, folder: str, generation: int) -> None:
    rows.select("size", "row", "shard", "block").repartition("shard", "block").write.partitionBy("shard", "block").option("compression", "zstd").parquet(f"{folder}/g{generation}")


def write_shards(docs: DataFrame, shard: Column, count: int, folder: str | None = None, text_col: str = "text", block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> Shards:
    """Writes docs, all columns, as a sharded table; `shard` is an expression on its columns from 0 to count - 1, null counts as 0.

    A row's size is its text in UTF-8 and ROW_BYTES; null texts have none. A shard has as many blocks as its bytes need, and rows
    are dealt to them by a hash of the whole row, so that neither a hot id nor a large group of copies makes a large block;
    rows equal in all columns share one. Column names are free, as rows are stored as one struct.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = folder or f"{shared_dir(spark)}/strandlake-shards-{uuid.uuid4().hex}"
    names = [F.col(f"`{c}`") for c in docs.columns]
    src = docs.select(F.coalesce(shard.cast("int"), F.lit(0)).alias("shard"), (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.struct(*names).alias("row"))
    # One row a shard, `count` at most.
    sums = src.groupBy("shard").agg(F.greatest(F.lit(least_blocks), F.ceil(F.sum("size") / block_bytes)).cast("long").alias("n_blocks"))
    block = F.concat(F.lit("b"), F.col("shard").cast("string"), F.lit("_"), F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("string"))
    _write(src.join(F.broadcast(sums), "shard").withColumn("block", block), folder, 0)
    schema = "size long, shard int, block string"
    return Shards(folder, count, 1, written(_measured(spark.read.schema(schema).parquet(f"{folder}/g0"), 0), "blocks"), src.schema["row"].dataType)


def plan(shards: Shards, capacities: list[int]) -> DataFrame:
    """(generation, shard, block, target, quota, start, parts): the stretches of each block; parts is how many it has.

    A block with one stretch goes whole; start is where the stretch begins among the block's rows, the largest one first.
    """
    spark = shards.blocks.sparkSession
    moves, ends = [], {}
    for (i, j), size in sorted(transfers(shards.sizes(), capacities).items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        moves.append((i, j, ends.get(i, 0), ends.get(i, 0) + size))
        ends[i] = moves[-1][3]
    # At most one row for each old and each new shard.
    stretches = spark.createDataFrame(moves, "shard int, target int, low long, high long")
    along = Window.partitionBy("shard").orderBy("generation", "block")
    placed = shards.blocks.withColumn("end", F.sum("bytes").over(along)).withColumn("begin", F.col("end") - F.col("bytes"))
    met = placed.join(F.broadcast(stretches), "shard").where((F.col("begin") < F.col("high")) & (F.col("low") < F.col("end")))
    met = met.withColumn("quota", F.least("end", "high") - F.greatest("begin", "low"))
    block = Window.partitionBy("generation", "shard", "block")
    first = block.orderBy(F.desc("quota"), "target")
    return met.select("generation", "shard", "block", "target", "quota", (F.sum("quota").over(first) - F.col("quota")).alias("start"), F.count("*").over(block).alias("parts"))


def reshard(shards: Shards, capacities: list[int]) -> Shards:
    """The table with len(capacities) shards, of these sizes but for the rows at the ends of stretches.

    Blocks that stay whole keep their files. Of a split block, the largest rows come first and the largest stretch too, so that
    stretches end among small rows; a row goes where its middle lies. The old blocks' files are left, so that the old layout stays
    readable until its folder is deleted and a lost job is simply run again. An empty table has no blocks before and after.
    """
    spark = shards.blocks.sparkSession
    todo = written(plan(shards, capacities), "moves")
    g = shards.generations
    touched = todo.where("parts > 1 or target <> shard")
    whole, split = touched.where("parts = 1"), touched.where("parts > 1")
    keys = ["generation", "shard", "block"]
    moved = shards.rows(whole).join(whole.select(*keys, "target"), keys)
    rows = shards.rows(split.select(*keys).distinct())
    middle = F.sum("size").over(Window.partitionBy(*keys).orderBy(F.desc("size"), F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    at = rows.withColumn("middle", middle)
    ends = split.select(*keys, "target", "start", (F.col("start") + F.col("quota")).alias("stop"))
    dealt = at.join(ends, keys).where((F.col("middle") >= F.col("start")) & (F.col("middle") < F.col("stop"))).select(*moved.columns)
    new = moved.unionByName(dealt).select(F.col("target").alias("shard"), F.concat("block", F.lit(f"_g{g}")).alias("block"), "size", "row")
    _write(new, shards.folder, g)
    schema = "size long, shard int, block string"
    made = _measured(spark.read.schema(schema).parquet(f"{shards.folder}/g{g}"), g)
    kept = shards.blocks.join(touched.select(*keys).distinct(), keys, "left_anti")
    return Shards(shards.folder, len(capacities), g + 1, written(kept.select(*made.columns).unionByName(made), "blocks"), shards.rows_type)


def slots(shards: Shards, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, read from the files; slots number a shard's rows without gaps.

    The order is that of the blocks and, within one, of ids; equal rows may change places. Only blocks' counts meet in a shard.
    """
    before = Window.partitionBy("shard").orderBy("generation", "block")
    firsts = shards.blocks.select("generation", "shard", "block", (F.sum("n").over(before) - F.col("n")).alias("first"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    thin = shards.rows().select("generation", "shard", "block", F.col("row").getField(id_col).alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"))
    inside = F.row_number().over(Window.partitionBy("generation", "shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = thin.withColumn("inside", inside).join(firsts, ["generation", "shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))
