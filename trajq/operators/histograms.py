"""Histograms that merge exactly: bins on a grid of powers of two.

A bin is [b * 2**level, (b + 1) * 2**level). The level follows from the range of the data alone, the finest at
which it spans at most ``bins`` bins, so it only rises as data is added, and two bins of a level are one
bin of the next. Counts therefore never depend on the order or the batching of the data, and tables of
counts merge by shifting bins. Only finite values are counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.plans.lineage import measured

#: Most bins of a histogram (a power of two); a range spans at least half as many.
BIN_BITS = 12
#: Bins are whole numbers of at most 53 bits; finer levels than this are not used.
LEAST_LEVEL = -1000
QUANTILES = {"q01": 0.01, "q99": 0.99}


def two_to(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def exponent(v: Column) -> Column:
    """The largest e with 2**e <= v (null for 0); the logarithm is only a guess that is put right."""
    guess = F.floor(F.log2(v))
    return (guess + (two_to(guess + 1) <= v).cast("int") - (two_to(guess) > v).cast("int")).cast("int")


def level_of(lo: Column, hi: Column, bits: int = BIN_BITS) -> Column:
    """The level of a range."""
    spread = exponent(hi - lo) - bits + 1
    fits = F.floor(hi / two_to(spread)) - F.floor(lo / two_to(spread)) < (1 << bits)
    return F.greatest(F.lit(LEAST_LEVEL), exponent(F.greatest(F.abs(lo), F.abs(hi))) - 52, F.when(fits, spread).otherwise(spread + 1))


def dyadic_histogram(flat: DataFrame, keys: Sequence[str] = (), *, bits: int = BIN_BITS) -> DataFrame:
    """Counts of entries (keys, dim, x): keys, dim, ``level, bin, count, min, max``."""
    keys = [*keys, "dim"]
    x = F.col("x").cast("double")
    data = flat.select(*keys, x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ranges = measured(data.groupBy(*keys).agg(F.min("x").alias("min"), F.max("x").alias("max")).withColumn("level", level_of(F.col("min"), F.col("max"), bits)))
    binned = data.join(ranges, keys).withColumn("bin", F.floor(F.col("x") / two_to(F.col("level"))))
    return binned.groupBy(*keys, "level", "bin").agg(F.count("*").alias("count"), F.first("min").alias("min"), F.first("max").alias("max"))


def merge_histograms(rows: DataFrame, keys: Sequence[str] = (), *, bits: int = BIN_BITS) -> DataFrame:
    """One histogram per key and dimension from any number of histograms of its parts."""
    keys = [*keys, "dim"]
    ranges = rows.groupBy(*keys).agg(F.min("min").alias("_lo"), F.max("max").alias("_hi")).withColumn("_level", level_of(F.col("_lo"), F.col("_hi"), bits))
    far = F.least(F.col("_level") - F.col("level"), F.lit(63))
    shifted = rows.join(measured(ranges), keys).withColumn("bin", F.call_function("shiftright", F.col("bin"), far))
    return shifted.groupBy(*keys, F.col("_level").alias("level"), "bin").agg(F.sum("count").alias("count"), F.first("_lo").alias("min"), F.first("_hi").alias("max"))


def dyadic_quantiles(rows: DataFrame, keys: Sequence[str] = (), *, quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Left edge of the first bin at which the counts reach q * n, per key and dimension of merged histograms; with ``n``."""
    keys = [*keys, "dim"]
    w = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("count").over(Window.partitionBy(*keys))
    c = rows.withColumns({"_cum": F.sum("count").over(w), "_n": total})  # at most 2 ** bits rows a key
    edge = F.col("bin") * two_to(F.col("level"))
    return c.groupBy(*keys).agg(F.first("_n").alias("n"), *[F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_n"), edge)).alias(name) for name, q in (quantiles or QUANTILES).items()])
