"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import stored
from trajq.plans.lineage import SMALL_ROWS, checkpoint


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A round over edges of node numbers with hi > lo: neighbours hang below the smallest of a node, then the smaller ones below their smallest."""
    u, v = np.concatenate([hi, lo]), np.concatenate([lo, hi])
    nodes, at = np.unique(u, return_inverse=True)
    low = nodes.copy()
    np.minimum.at(low, at, v)
    up = v > u
    hi, lo = v[up], low[at[up]]
    nodes, at = np.unique(hi, return_inverse=True)
    best = nodes.copy()
    np.minimum.at(best, at, lo)
    rest = lo != best[at]
    edges = np.unique(np.concatenate([lo[rest], nodes]) << 32 | np.concatenate([best[at[rest]], best]))
    return edges >> 32, edges & 0xFFFFFFFF


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (hi, lo) of one partition, in rounds of ``stars`` until nothing changes."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    ends = [pa.concat_arrays([b.column(i) for b in parts]) for i in (0, 1)]
    names, codes = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ends]), return_inverse=True)
    hi, lo = codes.reshape(2, -1)
    while True:
        up, down = stars(hi, lo)
        if np.array_equal(up, hi) and np.array_equal(down, lo):
            break
        hi, lo = up, down
    tops = np.unique(lo)
    found = (np.concatenate([hi, tops]), np.concatenate([lo, tops]))
    yield pa.RecordBatch.from_arrays([pa.array(names[x], ends[0].type) for x in found], ["node", "component"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    Each round hangs neighbours below smaller nodes, so long chains halve; the number of edges never
    grows. Only a count and a checksum reach the driver. Edges that count few rows go through the same
    rounds in one task, so the driver plans and broadcasts nothing for them.
    """
    e = stored(edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi <> lo").distinct(), "ends")
    if e.count() <= SMALL_ROWS:
        kind = e.schema["hi"].dataType.simpleString()
        return stored(e.coalesce(1).mapInArrow(solved, f"node {kind}, component {kind}"), "components")
    seen = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(best, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        hung = small.unionAll(best.select("hi", F.col("m").alias("lo")))
        e = checkpoint(hung.distinct())
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
