"""Quality: Bradley-Terry scores learned from preference pairs.

Every text is described by about thirty measurements of its bytes, words and lines. From a bounded sample of
labelled rows, pairs of a good and a bad document are drawn, and the weights of a linear score are fitted by the
logistic loss of the pairs' feature differences. The score at the quantile given by the sample's share of bad
documents becomes the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune
from .words import lists, texts

#: Byte classes that are counted (fixed values).
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"*#$%&@^~=+_", b"<>{}[]\\/"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[np.frombuffer(_c, np.uint8)] = _i
_N = len(CLASSES) + 1
_LINE = (0, 6, 7, 8)  # classes whose largest share in a line counts
WIDTH = 3 * (_N + len(_LINE) + 8) + 1


def measure(text: bytes) -> np.ndarray:
    """The measurements of a whole text: shares, their square roots, whether they are over 2 %, and the size."""
    if not text:
        return np.zeros(WIDTH, np.float32)
    cls = _CLASS[np.frombuffer(text, np.uint8)]
    share = np.bincount(cls, minlength=_N) / len(cls)
    ends = np.append(np.flatnonzero(cls == 4), len(cls))
    size = np.diff(ends, prepend=-1)
    by_line = []
    for k in _LINE:
        c = np.concatenate([[0], np.cumsum(cls == k)])
        there = c[ends]
        n = np.diff(there, prepend=0)
        by_line.append(float((n / np.maximum(size, 20)).max()))
    words = text.split()
    n = max(1, len(words))
    same = np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]]).astype(np.int8)))
    run = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    lines = [x for x in text.split(b"\n") if x]
    word_bytes = sum(map(len, words)) / n
    rest = [
        same.mean() if len(same) else 0.0, min(1.0, run / 10), len(set(words)) / n, min(1.0, word_bytes / 20),
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, 1 / n), float(share[5] == 0), min(1.0, n / max(1, len(ends)) / 100),
    ]
    f = np.concatenate([share, by_line, rest])
    return np.concatenate([f, np.sqrt(f), f > 0.02, [np.log1p(len(text)) / 10]]).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or b"") for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows, pa.float32())], names=["doc_id", "features"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every whole text; null and empty texts have all zeros."""
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_measured, "doc_id long, features array<float>")


@dataclass
class Ranking:
    """Linear Bradley-Terry score w.x, its threshold, and the slope that turns it into a probability."""

    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def score(self, x: Column) -> Column:
        """0 to 1; `cut` exactly at the threshold, rising with w.x."""
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        raw = F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        shift = float(np.log(self.cut / (1 - self.cut)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * (raw - F.lit(self.threshold)) + F.lit(shift))))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 20_000, penalty: float = 0.02, cut: float = 0.3, seed: int = 5) -> Ranking:
    """Fits the ranking to preference pairs; without both kinds every score is 0.5."""
    if good.all() or not good.any():
        return Ranking(np.zeros(x.shape[1]), 0.0, 0.0, 0.5)
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    d = (x[rng.choice(a, pairs)] - x[rng.choice(b, pairs)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of preferring the wrong one
        g = -(d * p[:, None]).mean(axis=0) + penalty * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    raw = x @ w
    threshold = float(np.quantile(raw, (~good).mean()))
    best = max((float(s) for s in np.geomspace(0.1, 20, 40)), key=lambda s: -np.logaddexp(0, np.where(good, -1, 1) * (s * (raw - threshold) + np.log(cut / (1 - cut)))).mean())
    return Ranking(w, threshold, best, cut)


def fit(measured: DataFrame, labelled: DataFrame, sample: int = 6000, cut: float = 0.3, seed: int = 5) -> Ranking:
    """Fits on a bounded sample: `sample` labelled ids (doc_id, good boolean), picked by their hash.

    An id that repeats among the texts stands for one of them, that with the least features; one that repeats among the labels is
    good only if all say so.
    """
    some = labelled.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.bool_and("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = measured.join(F.broadcast(some), "doc_id").groupBy("doc_id", "good").agg(F.min("features").alias("features")).collect()
    if not rows:
        return Ranking(np.zeros(WIDTH), 0.0, 0.0, 0.5)
    rows.sort(key=lambda r: r["doc_id"])
    return fit_pairs(np.array([r["features"] for r in rows], np.float64), np.array([r["good"] for r in rows], bool), cut=cut, seed=seed)


def scored(measured: DataFrame, ranking: Ranking, cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted). Empty and null texts are scored like any other; ties get equal scores."""
    return measured.select("doc_id", ranking.score(F.col("features")).alias("score")).withColumn("predicted", (F.col("score") >= F.lit(cut)).cast("int"))
