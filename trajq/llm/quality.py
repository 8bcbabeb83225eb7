"""Quality by pairwise ranking: Bradley-Terry scores, thresholded at a score quantile.

Each preferred document (label 1) is set against others (label 0); a linear score is learned from
the logistic loss of feature differences, so only the order of documents matters. The threshold is
the score quantile at the share of label 0. Means, pairs, loss and quantile are Spark jobs over every
labelled document that may be learned from: each stands in a pair at least, and the quantile is exact.

Features are shares of characters, repeated lines and repeated words of the whole text. Null text counts as empty. Without
labels of both classes every document scores 1 (or 0, where only label 0 is known). Repeated rows
are scored each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm import labelled
from trajq.llm.common import Words, stored
from trajq.plans.lineage import measured
from trajq.plans.ordered import global_index
from trajq.plans.quantiles import exact_quantiles

#: Pairs that the weights are fitted on at least; Newton steps at most; labelled documents of a block.
PAIRS, STEPS, BLOCK = 20_000, 40, 1 << 15


def features(texts: list[str], words: Words | None = None) -> np.ndarray:
    hashes, bounds = (words or Words()).of_texts([t.encode() for t in texts])
    ranges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    again = np.array([(hashes[a + 1 : b] == hashes[a : b - 1]).sum() / max(1, b - a) for a, b in ranges])
    distinct = np.array([len(np.unique(hashes[a:b])) / max(1, b - a) for a, b in ranges])
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    counts = np.bincount(doc * 256 + buf, minlength=256 * len(raw)).reshape(-1, 256).astype(np.float64)
    share = counts / np.maximum(sizes, 1)[:, None]
    upper, lower, digit = share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1)
    space = share[:, 9:14].sum(1) + share[:, 32]
    marks = np.delete(share[:, 33:127], np.r_[15:25, 32:58, 64:90], axis=1)
    many = counts[:, 32] + counts[:, 9:14].sum(1) + 1
    lines = [t.split("\n") for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    cols = [upper, lower, digit, space, share[:, 10], share[:, 128:].sum(1), upper / np.maximum(upper + lower, 1e-9), np.log1p(sizes), np.log1p(sizes / many), repeated, again, np.sqrt(again), distinct]
    return np.column_stack([*cols, np.sqrt(marks), np.sqrt(marks.sum(1))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    constant: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weight

    def score(self, texts: list[str], words: Words | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.rank(features(texts, words)) - self.threshold, -50, 50)))


def partials(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], column: str = "x", kind: type = np.float64) -> list[np.ndarray]:
    """``of`` (a few numbers) the feature rows of each task, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
                total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["p"])

    return [np.frombuffer(r["p"], np.float64) for r in rows.select(column).mapInArrow(run, "p binary").collect()]


def moments(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every feature, in two passes."""
    mean = sum(partials(rows, lambda x: x.sum(0))) / n
    return mean, np.sqrt(sum(partials(rows, lambda x: ((x - mean) ** 2).sum(0))) / n)


def paired(rows: DataFrame, model: Model, counts: dict[int, int], pairs: int = PAIRS) -> DataFrame:
    """Differences of standardized features, label 1 less label 0, as float32 bytes. Stored.

    Every document of the larger class, in an order by hash, meets the next one of the other class, which
    is gone through again and again; it meets several, where that gives fewer than ``pairs`` pairs.
    """
    many = max((0, 1), key=lambda y: (counts[y], y))
    few, again = 1 - many, -(-pairs // counts[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (model.standard(np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(batch.num_rows, -1)) for i in (0, 1))
                d = (a - b if many else b - a).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in d], pa.binary())], ["d"])

    side = {y: global_index(rows.where(F.col("y") == y).select(F.xxhash64("x", "doc_id").alias("h"), "x"), ["h", "x"], "i") for y in (0, 1)}
    left = side[many].select("x", F.explode(F.sequence(F.lit(0), F.lit(again - 1))).alias("c"), "i")
    left = left.select(F.col("x").alias("a"), F.pmod(F.col("i") + F.col("c"), F.lit(counts[few])).alias("k"))
    right = measured(side[few].select(F.col("i").alias("k"), F.col("x").alias("b")))
    return stored(left.join(right, "k").select("a", "b").mapInArrow(run, "d binary"), "pairs")


def bradley_terry(pairs: DataFrame, width: int, steps: int = STEPS, l2: float = 1e-3) -> np.ndarray:
    """Weights under which P(i preferred to j) = sigmoid(w . (x_i - x_j)) fits all pairs best: damped Newton steps."""

    def at(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def of(d: np.ndarray) -> np.ndarray:
            gain = d @ w
            miss = 1 / (1 + np.exp(np.clip(gain, -30, 30)))
            return np.concatenate([[len(d), np.logaddexp(0, -gain).sum()], d.T @ miss, (d.T * (miss * (1 - miss)) @ d).reshape(-1)])

        return of

    w = np.zeros(width)
    best, least, step = w, np.inf, w
    for _ in range(steps):
        n, loss, *rest = sum(partials(pairs, at(w), "d", np.float32))
        loss = loss / n + l2 / 2 * (w @ w)
        if loss <= least:
            rest = np.array(rest) / n
            best, least = w, loss
            step = np.linalg.solve(rest[width:].reshape(width, width) + l2 * np.eye(width), rest[:width] - l2 * w)
        else:
            step = step / 2
        if np.abs(step).max() < 1e-6:
            break
        w = best + step
    return np.round(best, 9)


def threshold(rows: DataFrame, model: Model, counts: dict[int, int]) -> float:
    """``quantile_cut`` of all rows: midway between the two ranks that as many lie below as have label 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(model.rank(x))], ["r"])

    ranks = rows.select("x").mapInArrow(run, "r double")
    at = (counts[0] - 0.5) / (counts[0] + counts[1] - 1)
    return exact_quantiles(ranks, [], F.col("r"), {"t": at}).first()["t"]


def quantile_cut(rank: np.ndarray, y: np.ndarray, share: float) -> float:
    """The score below which ``share`` of the labelled rows lie, the classes weighed by their true shares."""
    order = np.argsort(rank, kind="stable")
    weight = np.where(y == 1, (1 - share) / max(1, (y == 1).sum()), share / max(1, (y == 0).sum()))[order]
    below = np.cumsum(weight)
    k = int(np.searchsorted(below, share - 1e-9))
    k = min(k, len(rank) - 2)
    return float((rank[order[k]] + rank[order[k + 1]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 3, held: int = 1) -> Model:
    rows = labelled.gathered(docs, labelled.training(labels, label, of, held), features, BLOCK)
    counts = labelled.classes(rows)
    if len(counts) < 2:
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, float(next(iter(counts), 1)))
    mean, deviation = moments(rows, sum(counts.values()))
    model = Model(mean, deviation + 1e-3, np.zeros(len(mean)), 0.0)
    model.weight = bradley_terry(paired(rows, model, counts), len(mean))
    model.threshold = threshold(rows, model, counts)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in [0, 1] of every text; at the threshold it is 0.5."""
    words = Words()
    return labelled.scored(docs, lambda texts: model.score(texts, words))
