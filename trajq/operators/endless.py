"""Addressable order: keyed permutations, endless weighted mixes, draws with replacement.

Which row stands at a position is computed from the position, so a mix can be continued anywhere, on any
cluster, and nothing is sorted or shuffled to randomize it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.operators.resample import draw
from trajq.plans.lineage import measured
from trajq.plans.ordered import global_index

#: Rounds of a permutation.
ROUNDS = 32
#: Weights are taken as fractions with at most this denominator.
GRAIN = 1_000_000


def permuted(i: Column, n: Column, *key: Column, seed: int = 0, rounds: int = ROUNDS, inverse: bool = False, portable: bool = False) -> Column:
    """Where a permutation of 0..n-1, chosen by seed and key, sends i (``inverse``: what it sends to i).

    Swap-or-not: in each round i and its mirror image k - i (modulo n) trade places if a hash of the
    larger of them says so. Exact for every n, and undone by the rounds in reverse.
    """
    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(draw(seed, *key, r, portable=portable), n) - x, n)
        flip = draw(seed, *key, r, F.greatest(x, mirror), portable=portable).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, mirror).otherwise(x)

    return F.aggregate(order, i.cast("bigint"), swap)


def shares(weights: Mapping[str, float]) -> dict[str, Fraction]:
    """Weights as fractions that sum to exactly 1 (the last takes what rounding leaves)."""
    total = sum(weights.values())
    if abs(total - 1.0) > 1e-6 or min(weights.values()) <= 0:
        raise ValueError(f"weights must be positive and sum to 1, not {total}")
    *names, last = weights
    out = {k: Fraction(weights[k]).limit_denominator(GRAIN) for k in names}
    return {**out, last: 1 - sum(out.values())}


def slots(position: Column, weights: Mapping[str, float]) -> Column:
    """(dataset, nth): whose row stands at a position, and how many of that data set stand before it.

    Each data set takes its share of the positions that those before it left, evenly spaced, so at any
    length L it has its weight times L to within the number of data sets.
    """
    rest, left, chosen = position.cast("bigint"), Fraction(1), None
    options: list[tuple[Column | None, str, Column]] = []
    parts = shares(weights)
    for name, w in parts.items():
        share = w / left
        if share == 1:
            options.append((None, name, rest))
            break
        p, q = F.lit(share.numerator).cast("bigint"), F.lit(share.denominator).cast("bigint")
        before = F.floor(rest / q) * p + F.floor(F.pmod(rest, q) * p / q)
        mine = F.floor(F.pmod(rest, q) * p / q) < F.floor((F.pmod(rest, q) + 1) * p / q)
        options.append((mine, name, before))
        rest, left = rest - before, left - w
    for mine, name, nth in reversed(options):
        slot = F.struct(F.lit(name).alias("dataset"), nth.cast("bigint").alias("nth"))
        chosen = slot if mine is None else F.when(mine, slot).otherwise(chosen)
    return chosen


def endless_mix(
    datasets: Mapping[str, tuple[DataFrame, float]], id_cols: Sequence[str], start: int, stop: int, *, seed: int = 42, number: str | None = None, rounds: int = ROUNDS, portable: bool = False,
) -> DataFrame:
    """Rows at positions [start, stop) of an endless mix: ``position, dataset, epoch`` and the columns of the data sets.

    A data set is gone through epoch by epoch, every row once in each, in an order of its own; scarce sets
    repeat sooner, so the weights hold at any length. ``number`` names a dense row number from 0 of each data
    set, if it has one; otherwise rows are numbered by ``id_cols``. One equi-join brings rows to
    positions: only positions are generated, and a row goes as often as it is due.
    """
    every, sizes = None, None
    for name, (df, _) in datasets.items():
        rows = (df.withColumnRenamed(number, "_row") if number else global_index(df, list(id_cols), "_row")).withColumn("dataset", F.lit(name))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        size = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("_n"))
        sizes = size if sizes is None else sizes.unionByName(size)
    empty = F.when(F.col("_n") == 0, F.raise_error(F.lit("an empty data set cannot be mixed")).cast("bigint")).otherwise(F.col("_n"))
    sizes = F.broadcast(sizes.withColumn("_n", empty))  # one row per data set
    slot = slots(F.col("position"), {k: w for k, (_, w) in datasets.items()})
    at = every.sparkSession.range(start, stop).select(F.col("id").alias("position"), slot.alias("s")).select("position", "s.dataset", "s.nth").join(sizes, "dataset")
    at = at.withColumn("epoch", F.floor(F.col("nth") / F.col("_n")))
    row = permuted(F.pmod("nth", "_n"), F.col("_n"), F.col("dataset"), F.col("epoch"), seed=seed, rounds=rounds, portable=portable)
    return at.select("position", "dataset", "epoch", row.alias("_row")).join(every, ["dataset", "_row"]).drop("_row")


def sample_with_replacement(df: DataFrame, groups: Sequence[str], id_cols: Sequence[str], k: int, *, at_most_all: bool = False, seed: int = 42, portable: bool = False) -> DataFrame:
    """k draws of ids per group, duplicates kept, with all rows of each drawn id: adds ``draw`` (0..k-1).

    ``at_most_all``: no more draws than the group has ids. Ids are numbered over the whole table, so no group is
    sorted in one task; draw t of a group of n is id number hash(seed, group, t) mod n. Null keys are keys too.
    """
    keys = [*groups, *id_cols]
    ids = global_index(df.select(*keys).distinct(), keys, "_at")
    sizes = measured(ids.groupBy(*groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    most = F.least(F.lit(k), F.col("_n")) if at_most_all else F.lit(k)
    block = 1000  # draws of a group are made in blocks
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((most - 1) / block).cast("int")))).repartition(*groups, "_b")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, most.cast("int")) - 1)))
    name = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    drawn = draws.select("draw", (F.col("_first") + F.pmod(draw(seed, *name, F.col("draw"), portable=portable), F.col("_n"))).alias("_at"))
    chosen = drawn.join(ids, "_at").drop("_at").alias("chosen")
    same = [F.col(f"all.{c}").eqNullSafe(F.col(f"chosen.{c}")) for c in keys]
    return df.alias("all").join(chosen, same).select("all.*", "chosen.draw")
