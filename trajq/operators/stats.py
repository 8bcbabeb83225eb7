"""Moments, quantiles and normalization statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.functions.rotations import rotation_delta
from trajq.functions.vectors import delta_mask
from trajq.operators.windows import HORIZON, action_horizon, episode_offsets
from trajq.plans.lineage import checkpoint, measured
from trajq.plans.quantiles import exact_quantiles

# Fixed values.
BINS = 5000
CONSTANT_TOL = 1e-8
XYZ_LIMIT = 50.0
ROT_TOL = 0.3


def flat_dims(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per vector entry: keys, ``dim``, ``x``."""
    return df.select(*keys, F.posexplode(value).alias("dim", "x"))


def vector_moments(flat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per dimension: count, mean, mean of squares, min, max, population std; at least two rows."""
    x = F.col("x").cast("double")
    return flat.groupBy(*keys, "dim").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.avg(x * x).alias("mean_sq"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"),
    ).where(F.col("count") >= 2)


def histogram_quantiles(flat: DataFrame, keys: Sequence[str] = (), *, quantiles: Mapping[str, float] | None = None, bins: int = BINS, moments: DataFrame | None = None) -> DataFrame:
    """Left edge of the first of ``bins`` equal bins whose cumulative count reaches q * n.

    Two passes: ranges, then counts per (dimension, bin). The bins span the final minimum and
    maximum, so the result does not depend on the order of the data. ``moments`` saves the first
    pass when they are known.
    """
    quantiles = quantiles or {"q01": 0.01, "q99": 0.99}
    keys = [*keys, "dim"]
    data = flat.select(*keys, F.col("x").cast("double").alias("x"))
    if moments is None:
        moments = measured(data.groupBy(*keys).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("count")))
    ranges = moments.select(*keys, F.col("min").alias("_lo"), F.col("max").alias("_hi"), F.col("count").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    slot = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = data.join(ranges, keys).groupBy(*keys, slot.alias("_bin")).agg(
        F.count("*").alias("_c"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_c").over(w))
    edge = F.col("_lo") + F.col("_bin") * ((F.col("_hi") - F.col("_lo")) / F.lit(bins))
    return counts.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_n"), edge)).alias(n) for n, q in quantiles.items()])


def identity_constant_dims(stats: DataFrame, *, tol: float = CONSTANT_TOL) -> DataFrame:
    """Dimensions without spread get mean 0, std 1, q01 -1, q99 1."""
    flat = (F.col("q99") - F.col("q01") <= tol) & (F.col("std") <= tol)
    new = {"mean": 0.0, "std": 1.0, "q01": -1.0, "q99": 1.0}
    return stats.withColumn("constant", flat).withColumns({c: F.when(F.col("constant"), v).otherwise(F.col(c)) for c, v in new.items()})


def norm_stats(flat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments, histogram quantiles and the identity rule in one table."""
    moments = measured(vector_moments(flat, keys))
    quantiles = histogram_quantiles(flat, keys, moments=moments)
    return identity_constant_dims(quantiles.join(moments, [*keys, "dim"]))


def row_cap(episodes: DataFrame, max_frames: int, *, index: str = "episode_index", size: int = 100_000) -> DataFrame:
    """Episodes in order until ``max_frames`` rows: ``take`` rows of each (the last one is cut).

    The cap is worked out on the small episodes table; frames then filter on ``frame_index < take``.
    """
    out = episode_offsets(episodes, index=index, size=size)
    take = F.least(F.col("length"), F.lit(max_frames) - F.col("from_index"))
    return out.withColumn("take", take).where(F.col("take") > 0).drop("from_index", "to_index")


def delta_rows(frames: DataFrame, rule: Sequence[bool] | Sequence[str] | None, *, keys: Sequence[str] = ("episode_index",), horizon: int = HORIZON, size: int = 1_000_000) -> DataFrame:
    """Look-ahead actions of each frame relative to its state, one row per (frame, step).

    ``rule``: a boolean mask for plain subtraction, or arm names for the rotation-aware form.
    """
    chunks = action_horizon(frames, keys, "frame_index", F.col("action"), horizon=horizon, size=size)
    rows = chunks.select(*keys, "frame_index", "state", F.explode("chunk").alias("action"))
    if rule is None:
        return rows
    if isinstance(rule[0], str):
        return rotation_delta(rows, arms=rule, guard=False)
    return rows.withColumn("action", delta_mask(F.array("action"), F.col("state"), rule)[0])


def norm_stats_multi(datasets: Sequence[tuple[DataFrame, Sequence | None]], *, max_frames: int | None = None, train_episodes: DataFrame | None = None, horizon: int = HORIZON, size: int = 1_000_000) -> DataFrame:
    """One set of statistics (``key`` state / actions) over several datasets, each with its own rule.

    ``max_frames`` caps the frames over the datasets in order; ``train_episodes`` (dataset,
    episode_index) keeps the train split.
    """
    flat = None
    tagged = [f.select(F.lit(i).alias("dataset"), "episode_index", "frame_index", "state", "action") for i, (f, _) in enumerate(datasets)]
    if train_episodes is not None:
        tagged = [f.join(train_episodes, ["dataset", "episode_index"], "left_semi") for f in tagged]
    if max_frames is not None:
        every = tagged[0]
        for f in tagged[1:]:
            every = every.unionByName(f)
        lens = every.groupBy("dataset", "episode_index").agg(F.count("*").alias("length"))
        stride = 1 << 40  # datasets follow each other in the running total
        lens = lens.withColumn("_at", F.col("dataset") * F.lit(stride) + F.col("episode_index"))
        kept = row_cap(lens, max_frames, index="_at").select("dataset", "episode_index", "take")
        tagged = [f.join(kept, ["dataset", "episode_index"]).where(F.col("frame_index") < F.col("take")).drop("take") for f in tagged]
    for f, (_, rule) in zip(tagged, datasets):
        state = flat_dims(f.withColumn("key", F.lit("state")), ["key"], "state")
        deltas = delta_rows(f, rule, keys=("dataset", "episode_index"), horizon=horizon, size=size)
        actions = flat_dims(deltas.withColumn("key", F.lit("actions")), ["key"], "action")
        part = state.unionByName(actions)
        flat = part if flat is None else flat.unionByName(part)
    return norm_stats(flat, ["key"])


def column_entries(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per entry: keys, ``column``, ``dim``, ``x``; a scalar column has one dimension, true counts as 1."""
    types = dict(df.dtypes)
    flat = None
    for c in columns:
        named = df.withColumn("column", F.lit(c))
        kind = types[c]
        source = F.col(f"`{c}`")
        if kind.startswith("array"):
            values = source.cast("array<int>").cast("array<double>") if "boolean" in kind else source.cast("array<double>")
            part = named.select(*keys, "column", F.posexplode(values).alias("dim", "x"))
        else:
            part = named.select(*keys, "column", F.lit(0).alias("dim"), (source.cast("int") if kind == "boolean" else source).cast("double").alias("x"))
        flat = part if flat is None else flat.unionByName(part)
    return flat


def moment_rows(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable statistics: ``count, mean, m2`` (summed squared deviations), ``min, max`` per key, column and dimension."""
    x = F.col("x")
    return entries.groupBy(*keys, "column", "dim").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"))


def merge_moments(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moment rows of coarser keys from finer ones, of any grouping and any number of batches.

    The pairwise rule for all parts at once: deviations from the common mean are the parts' own plus
    count * (mean - common mean) ** 2. Only moment rows are read, twice; keep them written.
    """
    by = [*keys, "column", "dim"]
    n = F.sum("count")
    total = measured(rows.groupBy(*by).agg(n.alias("_n"), (F.sum(F.col("count") * F.col("mean")) / F.nullif(n, F.lit(0))).alias("_mean")))
    apart = F.col("mean") - F.col("_mean")
    return rows.join(total, by).groupBy(*by).agg(
        F.sum("count").alias("count"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("count") * apart * apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))


def moment_stats(rows: DataFrame) -> DataFrame:
    """``std`` (population) in place of ``m2``."""
    return rows.withColumn("std", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("count"))).drop("m2")


def column_stats(df: DataFrame, columns: Sequence[str], *, episode: str = "episode_index") -> DataFrame:
    """Min, max, mean, population std and count per column and dimension, per episode and overall.

    The overall rows have a null episode (``is_total`` = 1); they are merged from the episodes' rows.
    """
    rows = checkpoint(moment_rows(column_entries(df, columns, [episode]), [episode]))
    total = merge_moments(rows).withColumn(episode, F.lit(None).cast(df.schema[episode].dataType))
    marked = [moment_stats(r).withColumn("is_total", F.lit(i).cast("bigint")) for i, r in enumerate((rows, total))]
    return marked[0].unionByName(marked[1])


def delta_stats_check(stats: DataFrame, *, first: int = 10) -> DataFrame:
    """Do the action means look like deltas? ``xyz_small`` and ``rot_near_identity``."""
    mean = lambda i: F.max(F.when(F.col("dim") == first + i, F.col("mean")))
    return stats.agg(
        (F.greatest(*[F.abs(mean(i)) for i in range(3)]) < XYZ_LIMIT).alias("xyz_small"),
        ((F.abs(mean(3) - 1) < ROT_TOL) & (F.abs(mean(7) - 1) < ROT_TOL)).alias("rot_near_identity"),
    )


def quantile_table(df: DataFrame, keys: Sequence[str], value: Column, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key (see plans.quantiles)."""
    return exact_quantiles(df, keys, value, quantiles)
