"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads the bytes of each run of non-space characters from both sides and labels every byte position.
It is trained in numpy by backpropagation through time on words of labelled documents. A document's probabilities
are the mean, over all its byte positions, of the position's probabilities. As the state starts anew at each run,
equal runs have equal labels and are read once per batch; every position of the whole text still counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

#: Longest stretch read at once; longer runs are read in stretches of this many bytes at most, cut between characters.
STRETCH = 40
#: Labels for an unlettered text and for no label at all.
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights of the two directions (x: by byte, u: by state) and of the output layer."""

    labels: list[str]
    hidden: int
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        p["v"] = rng.normal(0, 0.2, (2 * hidden, len(labels))).astype(np.float32)
        p["c"] = np.zeros(len(labels), np.float32)
        return Network(labels, hidden, p)

    def _pass(self, d: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, (time, row, hidden); live is 0 behind a row's end."""
        k = self.hidden
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((*x.shape, k), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = self.p[f"x{d}"][x[t]]
            u = h @ self.p[f"u{d}"]
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * k] + u[:, : 2 * k]))
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            m = live[t][:, None]
            new = m * (n + z * (h - n)) + (1 - m) * h
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * k :]))
            out[t] = h = new
        return out

    def positions(self, x: np.ndarray, live: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(states, probabilities) for every position of x (time, row)."""
        s = np.concatenate([self._pass("f", x, live, keep and keep[0]), self._pass("b", x, live, keep and keep[1])], axis=2)
        y = s @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return s, y / y.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, live: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of all positions, by backpropagation through time."""
        k, keep = self.hidden, ([], [])
        s, y = self.positions(x, live, keep)
        y[:, np.arange(len(label)), label] -= 1
        y *= (live * weight)[:, :, None]
        g = {"v": np.einsum("tbh,tbl->hl", s, y), "c": y.sum(axis=(0, 1))}
        ds = y @ self.p["v"].T
        for d, saved, at in (("f", keep[0], slice(0, k)), ("b", keep[1], slice(k, 2 * k))):
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"u{d}"])
            dh = np.zeros((x.shape[1], k), np.float32)
            for t, h, z, r, n, un in reversed(saved):
                dh = dh + ds[t][:, at]
                m = live[t][:, None]
                dn, dz = m * dh * (1 - z) * (1 - n * n), m * dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, x[t], da)
                gu += h.T @ du
                dh = dh * (m * z + 1 - m) + du @ self.p[f"u{d}"].T
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return g


def stretches(run: bytes) -> list[bytes]:
    """A run cut into stretches, never inside a character of UTF-8."""
    out, a = [], 0
    while a < len(run):
        b = min(len(run), a + STRETCH)
        while b < len(run) and b > a + 1 and run[b] & 0xC0 == 0x80:
            b -= 1
        out.append(run[a:b])
        a = b
    return out


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, live), both (time, row), of runs of at most STRETCH bytes."""
    size = np.array([len(r) for r in runs])
    x = np.zeros((len(runs), max(1, size.max())), np.uint8)
    live = np.arange(x.shape[1])[None, :] < size[:, None]
    x[live] = np.frombuffer(b"".join(runs), np.uint8)
    return np.ascontiguousarray(x.T), np.ascontiguousarray(live.T.astype(np.float32))


def train(samples: list[tuple[bytes, str, float]], hidden: int = 20, epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits the network to all stretches of (run, label, weight) samples with Adam; needs one label at least."""
    labels = sorted({label for _, label, _ in samples})
    net, rng = Network.fresh(labels, hidden, seed), np.random.default_rng(seed)
    code = {label: i for i, label in enumerate(labels)}
    samples = [(part, code[label], w) for run, label, w in samples for part in stretches(run)]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        order = order[np.argsort([len(samples[i][0]) // 4 for i in order], kind="stable")]
        blocks = [order[i : i + batch] for i in range(0, len(order), batch)]
        for j in rng.permutation(len(blocks)):
            part = [samples[i] for i in blocks[j]]
            x, live = padded([s[0] for s in part])
            weight = np.array([s[2] for s in part], np.float32)
            g = net.gradients(x, live, np.array([s[1] for s in part]), weight / max(1e-6, float((live * weight).sum())))
            step += 1
            lr = rate * (1 - 0.8 * epoch / epochs)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500) -> DataFrame:
    """(text, lang) of about `sample_docs` different labelled texts, an equal share for each label and all of a rare one.

    Texts are picked by their hash against a threshold for their label, set by a count of different hashes, so only counts
    are shuffled and no text is. The same rows give the same sample.
    """
    some = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    some = some.withColumn("h", F.xxhash64("text", "lang"))
    # One row per label.
    held = {r["lang"]: r["n"] for r in some.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = sample_docs / max(1, len(held))
    picked = F.lit(False)
    for lang, n in sorted(held.items()):
        top = 2**63 - 1 if n <= share else int(share / n * 2**63)
        picked |= (F.col("lang") == lang) & (F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.lit(top))
    return some.where(picked).dropDuplicates(["h"]).select("text", "lang")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, sample_runs: int = 24_000, seed: int = 7) -> Network | None:
    """Trains on a bounded sample: the runs of about `sample_docs` documents, of which `sample_runs` different ones.

    Documents and runs are picked by their hash, as many for each label. None without a label.
    """
    some = sample(labelled, text_col, lang_col, sample_docs)
    runs = some.select("lang", F.explode(F.split("text", r"\s+")).alias("run")).where("run <> ''").groupBy("lang", "run").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("run", "lang"), "run")
    runs = runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_runs)
    rows = runs.orderBy("place", "lang").limit(sample_runs).collect()
    if not rows:
        return None
    return train([(r["run"].encode(), r["lang"], float(min(r["n"], 50)) ** 0.5) for r in sorted(rows, key=lambda r: (r["run"], r["lang"]))], seed=seed)


def label_runs(net: Network, runs: list[bytes], block: int = 4096) -> np.ndarray:
    """Sum of position probabilities of each run, (run, label)."""
    out = np.zeros((len(runs), len(net.labels)))
    parts = [(i, part) for i, r in enumerate(runs) for part in stretches(r)]
    parts.sort(key=lambda x: len(x[1]))
    for a in range(0, len(parts), block):
        part = parts[a : a + block]
        x, live = padded([r for _, r in part])
        _, y = net.positions(x, live)
        np.add.at(out, [i for i, _ in part], np.einsum("tbl,tb->bl", y, live))
    return out


def _predict(net: Network | None, names: list[str], place: int, cache_runs: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        sums = np.zeros((0, len(net.labels) if net else 0))
        for batch in batches:
            text = pc.fill_null(batch.column(place), "").cast(pa.large_string())
            lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            if net is None:
                best, score = [UNDETERMINED] * len(text), np.zeros(len(text))
            else:
                split = pc.utf8_split_whitespace(text)
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(cache) > cache_runs:
                    cache, sums = {}, sums[:0]
                fresh = [w for w in words if w not in cache]
                cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh))))
                if fresh:
                    sums = np.concatenate([sums, label_runs(net, [w.encode() for w in fresh])])
                here = sums[[cache[w] for w in words]] if words else sums[:0]
                total = np.zeros((len(text), len(net.labels)))
                owner = pc.list_parent_indices(split).to_numpy()
                each = coded.indices.to_numpy(zero_copy_only=False)
                for k in range(len(net.labels)):
                    total[:, k] = np.bincount(owner, weights=here[each, k], minlength=len(text)) if len(each) else 0
                norm = total.sum(axis=1)
                top = total.argmax(axis=1)
                score = np.where((norm > 0) & lettered, total[np.arange(len(text)), top] / np.maximum(norm, 1e-12), 0.0).clip(0, 1)
                best = [net.labels[k] if ok else UNDETERMINED for k, ok in zip(top, lettered)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=names
            )

    return run


def labelled(docs: DataFrame, net: Network | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns, the language of the whole text and its probability; the names must be free.

    A null text, and a text without a letter, gives `und` with score 0, as does a missing network. Repeated rows are
    judged one by one and alike; null ids are passed on; equal scores go to the label first in order. An empty table
    gives an empty result.
    """
    tune(docs.sparkSession)
    if {lang_name, score_name} & set(docs.columns):
        raise ValueError(f"{lang_name} or {score_name} is a column already")
    kinds = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(_predict(net, [f.name for f in kinds.fields], docs.columns.index(text_col)), kinds)
