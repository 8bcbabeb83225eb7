"""Quantiles of a stream of vectors: mergeable histograms in stream state."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajq.operators.histograms import BIN_BITS, LEAST_LEVEL, QUANTILES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "level int, first bigint, counts array<bigint>, lo double, hi double"
PART = f"key string, dim int, {STATE}"
OUTPUT = f"key string, dim int, n bigint, {STATE}, " + ", ".join(f"{q} double" for q in QUANTILES)


def level_of(lo: float, hi: float) -> int:
    """As histograms.level_of, with the exponents read off the numbers."""
    level = LEAST_LEVEL
    if lo or hi:
        level = max(level, math.frexp(max(abs(lo), abs(hi)))[1] - 1 - 52)
    if hi > lo:
        spread = math.frexp(hi - lo)[1] - BIN_BITS
        fits = math.floor(hi / 2.0**spread) - math.floor(lo / 2.0**spread) < 1 << BIN_BITS
        level = max(level, spread if fits else spread + 1)
    return level


class Histogram:
    """Counts of the bins first, first + 1, ... of a level, with the exact range of what they count."""

    def __init__(self, level: int = LEAST_LEVEL, first: int = 0, counts: Any = (), lo: float = math.inf, hi: float = -math.inf):
        self.level, self.first, self.counts, self.lo, self.hi = level, first, np.array(counts, np.int64), lo, hi

    def rise(self, level: int) -> None:
        """Coarsen to a level: bins meet in pairs, level by level at once."""
        far = min(level - self.level, 63)
        if far > 0 and len(self.counts):
            bins = (self.first + np.arange(len(self.counts))) >> far
            self.first = int(bins[0])
            self.counts = np.bincount(bins - bins[0], self.counts).astype(np.int64)
        self.level = level

    def put(self, bins: np.ndarray, counts: np.ndarray | None) -> None:
        low, high = int(bins.min()), int(bins.max())
        if len(self.counts):
            low, high = min(low, self.first), max(high, self.first + len(self.counts) - 1)
        new = np.zeros(high - low + 1, np.int64)
        if len(self.counts):
            new[self.first - low : self.first - low + len(self.counts)] = self.counts
        np.add.at(new, bins - low, 1 if counts is None else counts)
        self.first, self.counts = low, new

    def add(self, x: np.ndarray) -> None:
        x = x[np.isfinite(x)]
        if len(x):
            self.widen(float(x.min()), float(x.max()))
            self.put(np.floor(x / 2.0**self.level).astype(np.int64), None)

    def widen(self, lo: float, hi: float) -> None:
        self.lo, self.hi = min(self.lo, lo), max(self.hi, hi)
        self.rise(level_of(self.lo, self.hi))

    def merge(self, other: Histogram) -> None:
        if len(other.counts):
            self.widen(other.lo, other.hi)
            other.rise(self.level)
            self.put(other.first + np.arange(len(other.counts)), other.counts)

    def row(self) -> tuple:
        return self.level, self.first, self.counts.tolist(), self.lo, self.hi

    def quantile(self, q: float) -> float:
        cum = np.cumsum(self.counts)
        return float((self.first + int(np.searchsorted(cum, q * cum[-1]))) * 2.0**self.level)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The histograms of a partition's vectors, so that a few rows a dimension are shuffled."""
    found: dict[tuple[str, int], Histogram] = {}
    for batch in batches:
        keys = np.array(batch.column(0).to_pylist(), object)
        vectors = batch.column(1)
        width = np.asarray(vectors.value_lengths().fill_null(0))
        for key in set(keys.tolist()):
            for w in set(width[keys == key].tolist()) - {0}:
                rows = np.flatnonzero((keys == key) & (width == w))
                x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, w)
                for dim in range(w):
                    found.setdefault((key, dim), Histogram()).add(x[:, dim])
    rows = [(k, d, *h.row()) for (k, d), h in found.items() if len(h.counts)]
    if rows:
        names, kinds = ("key", "dim", "level", "first", "counts", "lo", "hi"), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))


class Merger(StatefulProcessor):
    """One histogram per key and dimension; its state is bounded by the number of bins."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("histogram", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        whole = Histogram(*self.state.get()) if self.state.exists() else Histogram()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                whole.merge(Histogram(int(r.level), int(r.first), r.counts, float(r.lo), float(r.hi)))
        row = whole.row()
        self.state.update(row)
        yield pd.DataFrame([(key[0], key[1], int(whole.counts.sum()), *row, *(whole.quantile(q) for q in QUANTILES.values()))], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream_histograms(vectors: DataFrame, value: str, key: Column | None = None) -> DataFrame:
    """Per key and dimension of everything seen so far: ``n``, the histogram and its quantiles, whenever it changes (update mode).

    Each micro-batch folds its partitions into histograms first, so a hot key or dimension shuffles one
    row per partition. Vectors of unequal width count by dimension; null vectors and entries that
    are not finite are left out. The result after any batch equals ``dyadic_histogram`` of all rows so far.
    """
    rows = vectors.select(F.coalesce(key.cast("string") if key is not None else F.lit(""), F.lit("")).alias("key"), F.col(value).cast("array<double>").alias("value"))
    return rows.mapInArrow(fold, PART).groupBy("key", "dim").transformWithStateInPandas(statefulProcessor=Merger(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
