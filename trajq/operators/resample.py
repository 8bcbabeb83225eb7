"""Resampling tests.

A unit of the test is one row (an episode, a pair). Units are few and resamples many: the units travel as
one row of arrays, tasks take blocks of resample numbers, and a block is one matrix of draws
whose statistics are a matrix product. No row per (resample, unit) exists and nothing is shuffled but hit counts.
Every draw is a hash of (seed, resample, unit), so a lost task draws the same numbers again. Units with a
null value are left out.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.operators.evaluate import correlation
from trajq.plans.lineage import single
from trajq.plans.ordered import global_index

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT_LIMIT = 9
TIE = 1e-12  # the same pairing summed in another order counts as equal
FLAT = 1e-12  # a standard deviation below this counts as none
PERMUTATIONS, BOOTSTRAPS, SIGN_FLIPS = 200_000, 10_000, 20_000
#: Resamples of a block, and entries of the matrices a task works on.
BLOCK, ENTRIES = 1000, 1 << 21
#: More units than this do not travel as one row.
UNIT_LIMIT = 1_000_000


def draw(seed: int, *cols: Column, portable: bool = False) -> Column:
    """Hash of a draw, the same in every run.

    ``portable`` takes 60 bits of an MD5 text hash, which other engines can repeat; the default
    is much cheaper.
    """
    if not portable:
        return F.xxhash64(F.lit(seed), *cols)
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draws(seed: int, resamples: np.ndarray, n: int, portable: bool = False) -> np.ndarray:
    """Non-negative 60-bit draws, a row per resample and a column per unit; ``portable`` equals ``draw`` of the same name."""
    if portable:
        ends = [b"%d" % i for i in range(n)]
        text = b"".join([hashlib.md5(b"%d|%d|%b" % (seed, r, i)).digest()[:8] for r in resamples.tolist() for i in ends])
        return (np.frombuffer(text, ">u8") >> np.uint64(4)).astype(np.int64).reshape(len(resamples), n)
    x = resamples.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 0x2545F4914F6CDD1D % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the public splitmix64 finalizer
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(4)).astype(np.int64)


def standard(v: np.ndarray) -> np.ndarray:
    """Deviations in units of the population standard deviation over n, rowwise; zeros where there is no spread."""
    c = v - v.mean(axis=-1, keepdims=True)
    spread = np.sqrt((c * c).mean(axis=-1, keepdims=True))
    return np.divide(c, spread * v.shape[-1], out=np.zeros_like(c), where=spread >= FLAT)


def units(df: DataFrame, id_col: str, *values: str) -> DataFrame:
    """All units as one row: ``n`` and an array of each value in id order (``_0``, ``_1``, ...)."""
    row = F.struct(F.col(id_col).alias("id"), *[F.col(v).cast("double").alias(f"_{k}") for k, v in enumerate(values)])
    many = F.raise_error(F.lit(f"more than {UNIT_LIMIT} units; aggregate them first"))
    return df.agg(F.count("*").alias("n"), F.when(F.count("*") > UNIT_LIMIT, many.cast(f"array<{_struct(df, id_col, len(values))}>")).otherwise(F.array_sort(F.collect_list(row))).alias("u")).select(
        "n", *[F.col("u").getField(f"_{k}").alias(f"_{k}") for k in range(len(values))])


def _struct(df: DataFrame, id_col: str, n: int) -> str:
    return f"struct<id:{df.schema[id_col].dataType.simpleString()}," + ",".join(f"_{k}:double" for k in range(n)) + ">"


def by_blocks(one: DataFrame, resamples: int, statistics: Callable[..., np.ndarray], schema: str = "s double") -> DataFrame:
    """``statistics(first, last, arrays...)`` of resamples first..last-1, a number each, over all resamples."""
    arrays = [c for c in one.columns if c != "n"]
    blocks = -(-resamples // BLOCK)
    rows = one.sparkSession.range(0, blocks, 1, min(blocks, 4 * one.sparkSession.sparkContext.defaultParallelism)).withColumn("_u", single(one)).select("id", *[f"_u.{c}" for c in arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = [np.asarray(batch.column(1 + i)[k].values, np.float64) for i in range(len(arrays))]
                n = max(1, len(values[0]))
                first = batch.column(0)[k].as_py() * BLOCK
                last, step = min(first + BLOCK, resamples), max(1, ENTRIES // n)
                for at in range(first, last, step):
                    yield pa.RecordBatch.from_arrays([pa.array(statistics(at, min(last, at + step), *values), pa.float64())], ["s"])

    return rows.mapInArrow(run, schema)


def _p_value(stat: DataFrame, one: DataFrame, observed: Column, plus_one: bool = True) -> DataFrame:
    """observed, p, n, resamples from one statistic per resample."""
    row = single(one.select("n", observed.alias("observed")))
    out = stat.withColumns({"observed": row["observed"], "n": row["n"]})
    hit = F.count(F.when(F.abs("s") >= F.abs("observed") - TIE, 1))
    p = (hit + 1) / (F.count("*") + 1) if plus_one else hit / F.count("*")
    return out.agg(F.first("observed").alias("observed"), p.alias("p"), F.first("n").alias("n"), F.count("*").alias("resamples"))


def permutation_test(df: DataFrame, id_col: str, x: str, y: str, *, resamples: int = PERMUTATIONS, seed: int = 0, plus_one: bool = True, portable: bool = False) -> DataFrame:
    """Two-sided p of the correlation under random pairings: observed, p, n, resamples; one row.

    ``plus_one`` gives (c + 1) / (m + 1), else c / m.
    """
    def pairings(first, last, a, b):
        order = np.argsort(draws(seed, np.arange(first, last), len(a), portable), axis=1, kind="stable")
        return standard(a)[order] @ (standard(b) * len(b))  # draw order is the new place of each x

    df = df.dropna(subset=[x, y])
    one = units(df, id_col, x, y)
    observed = df.agg(correlation(F.col(x), F.col(y))).scalar()
    return _p_value(by_blocks(one, resamples, pairings), one, observed, plus_one)


def exact_permutation_test(df: DataFrame, id_col: str, x: str, y: str, *, resamples: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """All n! pairings for n <= 9 units: observed, p, total; one row. More units: c / m of random pairings.

    A permutation number is decoded where it is drawn; the units travel as one row.
    """
    df = df.dropna(subset=[x, y])
    n = df.count()
    if n > EXACT_LIMIT:
        return permutation_test(df, id_col, x, y, resamples=resamples, seed=seed, plus_one=False).select("observed", "p", F.col("resamples").alias("total"))

    def pairings(first, last, a, b):
        code = np.arange(first, last)
        pool = np.tile(np.arange(n), (len(code), 1))
        order = np.empty_like(pool)
        for k in range(n):
            pick, code = np.divmod(code, factorial(n - 1 - k))
            at = np.arange(len(code))
            order[:, k] = pool[at, pick]
            keep = np.ones(pool.shape, bool)
            keep[at, pick] = False
            pool = pool[keep].reshape(len(code), -1)
        return standard(b)[order] @ (standard(a) * n)

    one = units(df, id_col, x, y)
    observed = df.agg(correlation(F.col(x), F.col(y))).scalar()
    return _p_value(by_blocks(one, factorial(n), pairings), one, observed, plus_one=False).select("observed", "p", F.col("resamples").alias("total"))


def sign_flip_test(df: DataFrame, id_col: str, diff: str, *, resamples: int = SIGN_FLIPS, seed: int = 0, portable: bool = False) -> DataFrame:
    """Two-sided p of the mean paired difference under random signs: observed, p, n; one row."""
    def flips(first, last, d):
        return (1 - 2 * (draws(seed, np.arange(first, last), len(d), portable) & 1)) @ d / max(1, len(d))

    df = df.dropna(subset=[diff])
    one = units(df, id_col, diff)
    return _p_value(by_blocks(one, resamples, flips), one, df.agg(F.avg(diff)).scalar()).drop("resamples")


def bootstrap_ci(df: DataFrame, id_col: str, x: str, y: str, *, resamples: int = BOOTSTRAPS, seed: int = 0, portable: bool = False) -> DataFrame:
    """Percentile interval 2.5/97.5 of the correlation over resamples with replacement: lo, hi, resamples; one row."""
    def again(first, last, a, b):
        at = draws(seed, np.arange(first, last), len(a), portable) % len(a)
        return (standard(a[at]) * standard(b[at])).sum(axis=1) * len(a)

    stat = by_blocks(units(df.dropna(subset=[x, y]), id_col, x, y), resamples, again)
    return stat.agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"), F.count("*").alias("resamples"))


def derangement_pair(df: DataFrame, id_cols: list[str], *, seed: int = 0) -> DataFrame:
    """Pair every row with another one, none with itself: hash order, each with the next.

    Adds ``_i`` (position in hash order) and ``partner_i``; join the table to itself on them.
    """
    from trajq.operators.sampling import hash_order

    d = global_index(df.withColumn("_h", hash_order(id_cols, seed)), ["_h", *id_cols], "_i").drop("_h")
    d = d.withColumn("_n", d.agg(F.count("*")).scalar())
    alone = F.raise_error(F.lit("need at least 2 rows for a derangement")).cast("bigint")
    return d.withColumn("partner_i", F.when(F.col("_n") < 2, alone).otherwise(F.pmod(F.col("_i") + 1, F.col("_n")))).drop("_n")
