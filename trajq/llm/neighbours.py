"""Nearest neighbours by multi-index hashing: learned rotated binary codes, pigeonhole probing, float rerank.

Inner product search becomes angular by one more coordinate that gives all rows the same norm. Codes
are signs after rotations learned on a sample (iterative quantization); a code is cut into bytes,
and each byte position has a table from value to rows. A query with radius R probes, in each of the
M tables, the values within floor(R / M) bits of its own: a code within R bits must agree that well in
some table, so every such code is retrieved. Retrieved codes are held against R in full, the rest is
ranked by inner products of the original vectors in double precision.

The radius is the smallest under which the sample's queries find all but MISS of their neighbours.
Every row is indexed, in blocks of bounded size dealt by a hash; each block of queries visits each
block of rows, and only the k best of a visit are emitted.

Vectors that are null, zero, hold null or non-finite components, or have another length than most
take no part. A query's own vec_id is no candidate. Equal scores are ordered by vec_id; repeated
rows count each on its own: as candidates, and as queries, each of which gets k hits under its query_id. Too few rows give all candidates; none give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq.llm.common import stored

#: Rows that codes and radius are fitted on, at most.
SAMPLE = 4096
ROTATIONS, STEPS = 2, 30
MISS = 0.02
#: Rows and queries of a block.
BLOCK, QUERIES = 8192, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles. Stored."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return stored(rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)), "vectors")


class Codes:
    """Rotations learned by iterative quantization, and codes under them."""

    def __init__(self, sample: np.ndarray, norm: float, rotations: int = ROTATIONS, steps: int = STEPS):
        self.norm = norm
        x = self.lifted(sample)
        width = -(-x.shape[1] // 8) * 8
        rng = np.random.default_rng(3)
        self.mean = x.mean(0)
        self.rotations = []
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x - self.mean
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(steps):  # rotation that brings the vectors nearest to their signs
                a, _, b = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (a @ b).T
            self.rotations.append(r)
        self.tables = rotations * width // 8

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """One coordinate more, so that all rows have the norm 1."""
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1) / self.norm**2))
        return np.column_stack([v / self.norm, rest]) if rest.max(initial=0) > 1e-3 else v / self.norm

    def of(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        width = len(self.rotations[0])
        y = np.zeros((len(v), width))
        if query:
            y[:, : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
        else:
            x = np.column_stack([v / self.norm, np.sqrt(np.maximum(0, 1 - (v * v).sum(1) / self.norm**2))])
            y[:, : min(len(self.mean), x.shape[1])] = x[:, : len(self.mean)]
        y[:, : len(self.mean)] -= self.mean
        return np.column_stack([np.packbits(y @ r >= 0, axis=1) for r in self.rotations])


POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: All byte values by their distance to zero: value XOR these probes a ball.
BALLS = [np.flatnonzero(POPCOUNT <= r).astype(np.uint8) for r in range(9)]


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int32)


class Index:
    """Tables from byte values to rows, one per byte of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.first = np.stack([np.searchsorted(codes[self.order[:, t], t], np.arange(257)) for t in range(codes.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius`` bits, all of them."""
        hit = np.zeros(len(self.codes), bool)
        ball = BALLS[min(8, radius // len(code))]
        for t, byte in enumerate(code.tolist()):
            values = ball ^ np.uint8(byte)
            start, size = self.first[t][values], self.first[t][values.astype(np.int64) + 1] - self.first[t][values]
            total = int(size.sum())
            if total:
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
                hit[self.order[at, t]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], code) <= radius]


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return (v * q[None]).sum(axis=1)


def best(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough = v @ q
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        keep = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
        ids, v = ids[keep], v[keep]
    score = exact(v, q)
    order = np.lexsort([ids, -score])[:k]
    return ids[order], score[order]


def calibrated(codes: Codes, sample: np.ndarray, k: int, miss: float = MISS) -> int:
    """The radius that holds all but ``miss`` of the sample's k nearest pairs."""
    pick = sample[:: max(1, len(sample) // 256)]
    rows, found = codes.of(sample), []
    for q, code in zip(pick, codes.of(pick, query=True)):
        score = sample @ q
        top = np.argpartition(-score, min(k, len(score) - 1))[: k + 1]
        found.append(distances(rows[top], code))
    return int(np.ceil(np.quantile(np.concatenate(found), 1 - miss)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = usable(vectors)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(norm2).alias("m")).first()
    schema = "query_id long, copy long, vec_id long, score double"
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] for r in got])
    codes = Codes(sample, float(facts["m"]) ** 0.5)
    radius = calibrated(codes, sample, k)
    row_blocks, query_blocks = -(-facts["n"] // block), max(1, -(-(facts["q"] or 0) // queries))
    spread = F.xxhash64("vec_id", F.lit(9))
    is_query = F.col("vec_id") % every == 0
    own_rows = F.transform(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda b: b * row_blocks + F.pmod(spread, F.lit(row_blocks)))
    own_queries = F.transform(F.sequence(F.lit(0), F.lit(row_blocks - 1)), lambda b: F.pmod(spread, F.lit(query_blocks)) * row_blocks + b)
    asked = rows.where(is_query).withColumn("copy", F.monotonically_increasing_id())  # rows are stored, so a row read again has the same number
    visits = rows.select("vec_id", "v", F.lit(0).alias("role"), F.explode(own_rows).alias("visit"), F.lit(0).cast("long").alias("copy")).unionAll(asked.select("vec_id", "v", F.lit(1).alias("role"), F.explode(own_queries).alias("visit"), "copy"))
    n = row_blocks * query_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, index, v = None, [], [], None, None
        for batch in batches:
            visit, role, key = (batch.column(i).to_numpy() for i in range(3))
            flat = batch.column(3)
            copy = batch.column(4).to_numpy()
            values = flat.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            cuts = np.flatnonzero(np.diff(visit * 2 + role, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], batch.num_rows]):
                if visit[i] != place:
                    place, ids, parts, index = visit[i], [], [], None
                if role[i] == 0:
                    ids.append(key[i:j])
                    parts.append(values[i:j])
                    continue
                if not ids:
                    continue
                if index is None:
                    v, known = np.concatenate(parts), np.concatenate(ids)
                    index = Index(codes.of(v))
                out = []
                for q, own, number, code in zip(values[i:j], key[i:j].tolist(), copy[i:j].tolist(), codes.of(values[i:j], query=True)):
                    near = index.within(code, radius)
                    near = near[known[near] != own]
                    if len(near) < k:  # sparse surroundings: the ball grows until it holds k, or all
                        wide = radius
                        while len(near) < k and wide < 8 * len(code):
                            wide += max(4, radius // 4)
                            near = index.within(code, wide)
                            near = near[known[near] != own]
                    found, score = best(known[near], v[near], q, k)
                    out.append((np.full(len(found), own), np.full(len(found), number), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "copy", "vec_id", "score"])

    ordered = visits.repartitionById(n, F.col("visit").cast("int")).sortWithinPartitions("visit", "role", "vec_id").select("visit", "role", "vec_id", "v", "copy")
    hits = ordered.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
