"""Exact interpolated quantiles of large groups.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a sketch
brackets each wanted rank (its rank error is bounded by 1/accuracy), everything below the bracket
collapses into one count, and only the values inside the bracket are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.plans.lineage import checkpoint, measured, single
from trajq.plans.ordered import running_sum

ACCURACY = 10_000
SLOTS = 1000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, quantiles: Mapping[str, float], *, accuracy: int = ACCURACY
) -> DataFrame:
    """One row per key: ``n`` and one linearly interpolated quantile per output name.

    Nulls and NaN are left out. Rank of quantile q is q*(n-1), between the two nearest values.
    """
    keys = list(keys)
    data = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        data, keys = data.withColumn("_all", F.lit(0)), ["_all"]
        drop = ["_all"]
    else:
        drop = []
    names = list(quantiles)
    eps = 2.0 / accuracy
    asked = [p for n in names for p in (max(quantiles[n] - eps, 0.0), min(quantiles[n] + eps, 1.0))]
    brackets = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", asked, accuracy).alias("_b")
    )
    if drop:
        row = single(checkpoint(brackets))
        joined = data.withColumns({"_n": row["_n"], "_b": row["_b"]})
    else:
        joined = data.join(measured(brackets), keys)
    # Values below (slot -1) and above the bracket collapse into one group each; those inside are
    # ranked slot by slot, so no task sees a whole group.
    options = []
    for i, n in enumerate(names):
        lo, hi = F.element_at("_b", 2 * i + 1), F.element_at("_b", 2 * i + 2)
        side = F.when(F.col("_v") < lo, -1).when(F.col("_v") > hi, 1).otherwise(0)
        slot = F.when(hi > lo, F.least(F.floor((F.col("_v") - lo) / (hi - lo) * SLOTS), F.lit(SLOTS - 1))).otherwise(F.lit(0))
        slot = F.when(side < 0, -1).when(side > 0, SLOTS).otherwise(slot).cast("bigint")
        options.append(F.struct(F.lit(i).alias("q"), slot.alias("slot"), F.when(side == 0, F.col("_v")).alias("v")))
    ranked = (
        joined.select(*keys, "_n", "_v", F.explode(F.array(*options)).alias("_o"))
        .groupBy(*keys, F.col("_o.q").alias("_q"), F.col("_o.slot").alias("_slot"), F.col("_o.v").alias("_at"))
        .agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.max("_v").alias("_top"), F.min("_v").alias("_low"))
    )
    ranked = running_sum(ranked, [*keys, "_q"], ["_slot", "_at"], {"_cum": F.col("_c")}, size=1)
    q = F.element_at(F.array(*[F.lit(float(quantiles[n])) for n in names]), F.col("_q") + 1)
    rank = q * (F.col("_n") - 1)
    # A wanted rank lies in the bracket, or is the last value below or the first value above it.
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.when(F.col("_slot") < 0, F.col("_top")).otherwise(F.col("_low"))))
    picked = (
        ranked.withColumn("_r", rank)
        .groupBy(*keys, "_q")
        .agg(
            at(F.floor("_r")).alias("_lo"),
            at(F.ceil("_r")).alias("_hi"),
            F.first(F.col("_r") - F.floor("_r")).alias("_f"),
            F.first("_n").alias("_n"),
        )
        .withColumn("_x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    )
    out = picked.groupBy(*keys).agg(
        F.first("_n").alias("n"), *[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)]
    )
    return out.drop(*drop)
