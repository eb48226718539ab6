"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt to shards of bounded size; each shard's task builds its graph in numpy. Then the
vectors of every shard query the graphs of every shard of their label, both ways in one task per pair of shards. Searches run
in lockstep for a whole shard. The beam is widened until a brute-force audit of some of the queries finds the
wanted recall among those whose beam is not full of links; a query whose beam is full scans the shard. Links are verified by
cosine in double precision. A task returns the number of links of each vector and one edge to the least vector it reaches inside
the two shards, never the links of a group one by one; these edges are united to components. Equal vectors are one node
from the start.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tune, written
from .components import components

#: Vectors of a shard on average; a shard's graph takes about 4 * (dimension + 48) bytes each.
SHARD_ROWS = 6000
#: Parts into which the rows of one vector are dealt, and found links that are verified at a time.
SALTS, AT_ONCE = 64, 100_000


def _select(sims: np.ndarray, between: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` of the candidates of each row, as a mask: first those nearer to the row than to any chosen one, then the
    nearest of the others. Candidates are sorted by similarity; -inf marks none."""
    rows, n = sims.shape
    chosen = np.zeros((rows, n), bool)
    near = np.full((rows, n), -np.inf)
    count = np.zeros(rows, np.int64)
    for j in range(n):
        ok = (sims[:, j] > near[:, j]) & np.isfinite(sims[:, j]) & (count < degree)
        chosen[:, j] = ok
        count += ok
        near = np.where(ok[:, None], np.maximum(near, between[:, j]), near)
    rest = ~chosen & np.isfinite(sims)
    chosen |= rest & (np.cumsum(rest, axis=1) <= (degree - count)[:, None])
    return chosen


class Graph:
    """Navigable small-world layers over unit vectors; layer 0 holds all nodes."""

    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 40, seed: int = 3):
        self.x = x.astype(np.float32)
        self.degree = degree
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(degree)).astype(int), 6)
        self.top = int(self.level.max())
        self.links = [np.full((n, 2 * degree if layer == 0 else degree), -1, np.int32) for layer in range(self.top + 1)]
        self.entry = -1
        done = 0
        while done < n:
            step = min(n - done, 64 if not done else min(192, done))
            self._insert(np.arange(done, done + step), beam)
            done += step

    def _insert(self, new: np.ndarray, beam: int) -> None:
        at = np.full(len(new), self.entry)
        top = int(self.level[self.entry]) if self.entry >= 0 else -1
        for layer in range(self.top, -1, -1):
            mine = np.flatnonzero(self.level[new] >= layer)
            found = np.zeros((len(new), 0), np.int64)
            if 0 <= layer <= top:
                ids, _ = self.search_layer(self.x[new], at, layer, beam)
                at = ids[:, 0]
                found = ids
            if not len(mine):
                continue
            own = new[mine]
            cand = np.concatenate([found[mine], np.broadcast_to(own, (len(own), len(own)))], axis=1)
            sims = np.where(cand < 0, -np.inf, np.einsum("acd,ad->ac", self.x[np.maximum(cand, 0)], self.x[own])) if cand.shape[1] * len(own) < 60_000 else self._sims(own, cand)
            sims[cand == own[:, None]] = -np.inf
            width = min(cand.shape[1], 3 * self.degree)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            v = self.x[np.maximum(cand, 0)]
            mask = _select(sims, v @ v.transpose(0, 2, 1), self.degree)
            table = self.links[layer]
            for i, node in enumerate(own):
                near = cand[i, mask[i]]
                table[node, : len(near)] = near
            self._back(layer, own, cand, mask)
        best = new[np.argmax(self.level[new])]
        if self.entry < 0 or self.level[best] > self.level[self.entry]:
            self.entry = int(best)

    def _sims(self, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
        out = np.empty(cand.shape, np.float32)
        for a in range(0, len(own), 32):
            out[a : a + 32] = np.einsum("acd,ad->ac", self.x[np.maximum(cand[a : a + 32], 0)], self.x[own[a : a + 32]])
        out[cand < 0] = -np.inf
        return out

    def _back(self, layer: int, own: np.ndarray, cand: np.ndarray, mask: np.ndarray) -> None:
        """Adds the reverse links; a full node keeps the best of old and new."""
        table = self.links[layer]
        width = table.shape[1]
        row, col = np.nonzero(mask)
        target, source = cand[row, col], own[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), count.max(initial=1)), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)] = source
        for a in range(0, len(nodes), 256):
            at = nodes[a : a + 256]
            every = -np.sort(-np.concatenate([table[at], more[a : a + 256]], axis=1), axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            every = -np.sort(-every, axis=1)
            held = (every >= 0).sum(axis=1)
            over = held > width
            table[at[~over]] = every[~over, :width]
            if not over.any():
                continue
            at, every = at[over], every[over, : held.max()]
            sims = np.full(every.shape, -np.inf, np.float32)
            r, c = np.nonzero(every >= 0)
            sims[r, c] = np.einsum("ad,ad->a", self.x[every[r, c]], self.x[at[r]])
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            every, sims = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1)
            v = self.x[np.maximum(every, 0)]
            chosen = _select(sims, v @ v.transpose(0, 2, 1), width)
            order = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
            table[at] = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(every, order, 1), -1)

    def search_layer(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best `beam` nodes met by each query, best first; -1 marks none."""
        rows, table = len(q), self.links[layer]
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -np.inf, np.float32)
        fresh = np.zeros((rows, beam), bool)
        seen = np.zeros((rows, len(self.x) + 1), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = start, np.einsum("ad,ad->a", self.x[start], q), True
        seen[np.arange(rows), start] = True
        live = np.arange(rows)
        step = min(step, beam)
        while len(live):
            f = fresh[live]
            rank = np.argsort(~f, axis=1, kind="stable")[:, :step]  # beams are sorted: the first fresh ones are the best
            ok = np.take_along_axis(f, rank, 1)
            cur = np.where(ok, np.take_along_axis(ids[live], rank, 1), -1)
            f[np.arange(len(live))[:, None], rank] = False
            fresh[live] = f
            near = np.where(cur[:, :, None] >= 0, table[np.maximum(cur, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1  # place -1 is the last one, which no node has
            seen[live[:, None], near] = True
            seen[:, -1] = False
            near = -np.sort(-near, axis=1)[:, : max(1, int((near >= 0).sum(axis=1).max()))]  # new nodes only
            r, c = np.nonzero(near >= 0)
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ad,ad->a", self.x[near[r, c]], q[live[r]])
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_fresh = np.concatenate([f, near >= 0], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            fresh[live] = np.take_along_axis(all_fresh, best, 1) & np.isfinite(sims[live])
            live = live[fresh[live].any(axis=1)]
        return np.where(np.isfinite(sims), ids, -1), sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self.search_layer(q, at, layer, 4)[0][:, 0]
        return self.search_layer(q, at, 0, beam)


def linked(graph: Graph, q: np.ndarray, least: float, recall: float = 0.99, audit: int = 64, beam: int = 24) -> tuple[np.ndarray, float]:
    """Which nodes (columns) each query (row) finds at similarity `least` or more, and the recall that the last audit measured."""
    q = q.astype(np.float32)
    soft = least - 1e-4  # single precision; the caller verifies
    found = np.zeros((len(q), len(graph.x)), bool)
    some = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    true = q[some] @ graph.x.T >= soft
    while beam < len(graph.x):
        ids, sims = graph.search(q[some], beam)
        open_ = ~(sims[:, -1] >= soft)  # full beams are scanned below, which needs no audit
        hit = np.zeros_like(true)
        r, c = np.nonzero((sims >= soft) & (ids >= 0))
        hit[r, ids[r, c]] = True
        wanted = true & open_[:, None]
        got = 1.0 if not wanted.any() else float((hit & wanted).sum() / wanted.sum())
        if got >= recall:
            break
        beam *= 2
    left, got = (np.arange(len(q)), 1.0) if beam >= len(graph.x) else (None, got)
    if left is None:
        ids, sims = graph.search(q, beam)
        r, c = np.nonzero((sims >= soft) & (ids >= 0))
        found[r, ids[r, c]] = True
        left = np.flatnonzero(sims[:, -1] >= soft)
    for a in range(0, len(left), 512):  # at least as many links as the beam holds: the shard is scanned
        found[left[a : a + 512]] = q[left[a : a + 512]] @ graph.x.T >= soft
    return found, got


def verified(found: np.ndarray, y: np.ndarray, x: np.ndarray, least: float) -> None:
    """Takes out of `found` (rows: y, columns: x, unit vectors in double precision) what is below `least`."""
    for a in range(0, len(y), 64):
        r, c = np.nonzero(found[a : a + 64])
        for b in range(0, len(r), AT_ONCE):
            i, j = r[b : b + AT_ONCE] + a, c[b : b + AT_ONCE]
            found[i, j] = np.einsum("ad,ad->a", y[i], x[j]) >= least


def reached(found: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Lowers the labels of rows and columns to the least one that links reach; the same array stands for both in one shard."""
    while True:
        before = rows.sum(), cols.sum()
        for a in range(0, len(rows), 512):
            r, c = np.nonzero(found[a : a + 512])
            np.minimum.at(rows, r + a, cols[c])
            np.minimum.at(cols, c, rows[r + a])
        if before == (rows.sum(), cols.sum()):
            return


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, unit vectors, weights) of a shard."""
    rows = cell.values
    ids = np.asarray(rows.field("node"))
    flat = np.asarray(rows.field("vec").flatten(), np.float64)
    return ids, _unit(flat.reshape(len(ids), -1)), np.asarray(rows.field("weight"), np.float64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = [pickle.dumps(vars(Graph(_vectors(cell)[1]))) for cell in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(graphs, pa.binary())], names=["label", "dim", "shard", "rows", "graph"])


def _graph(cell: pa.Scalar) -> Graph:
    graph = Graph.__new__(Graph)
    vars(graph).update(pickle.loads(cell.as_py()))
    return graph


def _query(least: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, graph_x, rows_x, graph_y, rows_y = (c[k] for c in batch.columns)
                own, y, wy = _vectors(rows_y)
                found, got = linked(_graph(graph_x), y, least, recall)
                if one.as_py():
                    ids, x, wx = own, y, wy
                    found |= found.T
                    np.fill_diagonal(found, False)
                else:
                    ids, x, wx = _vectors(rows_x)
                    back, again = linked(_graph(graph_y), x, least, recall)
                    found |= back.T
                    got = min(got, again)
                verified(found, y, x, least)
                n = np.concatenate([found[a : a + 512] @ wx for a in range(0, len(own), 512)])
                root = own.copy()
                if one.as_py():
                    reached(found, root, root)
                    sides = [(own, root, n)]
                else:
                    more = ids.copy()
                    reached(found, root, more)
                    sides = [(own, root, n), (ids, more, sum((wy[a : a + 512] @ found[a : a + 512] for a in range(0, len(own), 512)), np.zeros(len(ids))))]
                for node, to, links in sides:
                    ok = links > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[ok]), pa.array(to[ok]), pa.array(links[ok].astype(np.int64)), pa.array(np.full(int(ok.sum()), got))], names=["node", "root", "n", "recall"]
                    )

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, recall: float = 0.99, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall.

    Two vectors link when their labels are equal and not null, their dimensions are equal and their cosine is at least `least`. Vectors that are null,
    empty or zero, or hold null or non-finite values, link with nothing, as do rows with a null id (their component is null).
    Rows that repeat an id count as vectors of their own. recall is the least that an audit of the searches that found the vector's links
    measured, null without links of that kind. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark, 8)  # a row here holds a whole shard
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    sound = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & sound, F.lit(False))
    # Two hashes of label and vector name a class of equal vectors.
    named = src.select("*", F.when(sound, F.xxhash64("label", "vec")).alias("c1"), F.when(sound, F.xxhash64("vec", "label")).alias("c2"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    good = named.where("vec_id is not null and c1 is not null")
    classes = good.groupBy("c1", "c2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.collect_set("salt").alias("salts"))
    classes = written(classes.withColumn("dim", F.size("vec")), "classes")
    spread = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(spread, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("c1"), F.col("shards")).cast("int"))
    # A shard is a bounded group: about shard_rows vectors.
    shards = dealt.groupBy("label", "dim", "shard").agg(F.sort_array(F.collect_list(F.struct("node", "vec", "weight"))).alias("rows"))
    kind = "label string, dim int, shard int, rows array<struct<node:bigint,vec:array<double>,weight:bigint>>, graph binary"
    built = written(shards.mapInArrow(_build, kind), "graphs")
    names = built.select("label", "dim", F.col("shard").alias("a"))
    pairs = names.join(names.withColumnRenamed("a", "b"), ["label", "dim"]).where("a <= b").repartition(F.col("label"), F.col("dim"), F.col("a"), F.col("b"))
    left, right = (built.select("label", "dim", F.col("shard").alias(e), F.col("graph").alias(f"graph_{e}"), F.col("rows").alias(f"rows_{e}")) for e in "ab")
    asked = pairs.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"]).select((F.col("a") == F.col("b")).alias("one"), "graph_a", "rows_a", "graph_b", "rows_b")
    found = written(asked.repartition(max(1, names.count())).mapInArrow(_query(least, recall), "node long, root long, n long, recall double"), "links")
    discard(built)
    tune(spark)
    comp = components(found.select(F.col("root").alias("u"), F.col("node").alias("v")))
    others = found.groupBy("node").agg(F.sum("n").alias("more"), F.min("recall").alias("recall"))
    info = classes.select("c1", "c2", "node", "weight", "salts").join(others, "node", "left").join(comp.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
    info = info.select("c1", "c2", F.explode("salts").alias("salt"), (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "recall")
    out = named.select("vec_id", "c1", "c2", "salt").join(info, ["c1", "c2", "salt"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "recall"
    )
