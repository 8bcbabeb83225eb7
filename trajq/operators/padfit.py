"""Normalization fitted from glove frames: all of them, or a seeded sample where asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq.operators.sampling import hash_order, seeded_sample
from trajq.plans.lineage import checkpoint, measured
from trajq.plans.quantiles import exact_quantiles

# Fixed values.
SEED = 42
DEAD_STD = 1e-4
MIN_SCALE = 1e-6
HAND_KEYS = ["recording_id", "hand"]


def dead_sensor_exclude(tactile: DataFrame, *, limit: float = DEAD_STD) -> DataFrame:
    """Per recording and hand the largest pad std, and whether the sensor is dead."""
    cells = tactile.select(*HAND_KEYS, "pad", F.explode("force").alias("x"))
    per = cells.groupBy(*HAND_KEYS, "pad").agg(F.stddev_pop("x").alias("_s"))
    return per.groupBy(*HAND_KEYS).agg(F.max("_s").alias("max_std")).withColumn("dead", F.col("max_std") < limit)


def finite_cells(tactile: DataFrame, ids: Sequence[str]) -> DataFrame:
    cells = tactile.select(*ids, F.explode("force").alias("x"))
    return cells.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))


def pad_norm_fit(tactile: DataFrame, *, samples: int | None = None, seed: int = SEED, floor_by: Sequence[str] = ()) -> DataFrame:
    """Baseline, scale and contact threshold per (hand, pad), from all frames or ``samples`` per hand.

    ``floor_by`` (for instance the hand) says over which pads the scale floor is taken; empty
    means all. MAD needs the median first, hence the second quantile pass over the sample. A pad that
    occurs without any finite value fails the fit.
    """
    sampled = tactile if samples is None else seeded_sample(tactile, HAND_KEYS, ["sample_idx"], samples, seed=seed)
    pool = finite_cells(sampled, ["hand", "pad"])
    quantiles = exact_quantiles(pool, ["hand", "pad"], F.col("x"), {"base": 0.05, "high": 0.999, "med": 0.5})
    none = F.raise_error(F.concat(F.lit("no finite training values for pad "), F.concat_ws(" ", "hand", F.col("pad").cast("string")))).cast("double")
    seen = sampled.select("hand", "pad").distinct().join(quantiles, ["hand", "pad"], "left")
    first = measured(seen.withColumn("base", F.when(F.col("base").isNull(), none).otherwise(F.col("base"))))
    dev = pool.join(first.select("hand", "pad", "med"), ["hand", "pad"])
    mad = exact_quantiles(dev, ["hand", "pad"], F.abs(F.col("x") - F.col("med")), {"mad": 0.5}).drop("n")
    fit = first.join(mad, ["hand", "pad"]).withColumn("raw", F.greatest(F.col("high") - F.col("base"), F.lit(MIN_SCALE)))
    # At most 30 pads: the floor is a window over them.
    w = Window.partitionBy(*floor_by) if floor_by else Window.partitionBy(F.lit(0))
    middle = F.percentile(F.when(F.col("raw") > 1e-5, F.col("raw")), 0.5).over(w)
    fit = fit.withColumn("floor", F.greatest(F.coalesce(middle * 0.05, F.lit(1e-3)), F.lit(1e-5)))
    limit = F.greatest(F.col("med") + 4 * F.col("mad"), F.col("base") + 0.1 * F.col("raw"))
    fit = fit.withColumns({"scale": F.greatest("raw", "floor"), "_t": limit})
    threshold = F.greatest((F.col("_t") - F.col("base")) / F.col("scale"), F.lit(0.1))
    return fit.select("hand", "pad", "n", "base", "scale", threshold.alias("threshold"))


def robust_limits(tactile: DataFrame, *, shear: DataFrame | None = None, every: int | None = None, max_pads: int | None = None) -> DataFrame:
    """Display limits per recording and hand: P1/P99 of all samples and pads.

    ``every`` takes only every (n/every)-th sample, ``max_pads`` only the first pads, of gloves that
    have more. Without spread the limits fall back to min/max, then to lo + 1.
    """
    columns = ["force"] if shear is None else ["force", "shear_x", "shear_y"]
    both = tactile if shear is None else tactile.join(shear, [*HAND_KEYS, "pad", "sample_idx"], "left")
    if every is not None:
        n = measured(tactile.groupBy(*HAND_KEYS).agg((F.max("sample_idx") + 1).alias("_n")))
        both = both.join(n, HAND_KEYS).where(F.col("sample_idx") % F.greatest(F.floor(F.col("_n") / every), F.lit(1)) == 0)
    if max_pads is not None:
        w = Window.partitionBy(*HAND_KEYS).orderBy("pad")
        pads = tactile.select(*HAND_KEYS, "pad").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_pads)
        both = both.join(measured(pads.drop("_r")), [*HAND_KEYS, "pad"], "left_semi")
    both = checkpoint(both.select(*HAND_KEYS, *columns))
    cells = both.select(*HAND_KEYS, F.explode("force").alias("x")).where(~F.isnan("x"))
    q = exact_quantiles(cells, HAND_KEYS, F.col("x"), {"lo": 0.01, "hi": 0.99})
    q = q.join(measured(cells.groupBy(*HAND_KEYS).agg(F.min("x").alias("min"), F.max("x").alias("max"))), HAND_KEYS)
    bad = F.col("hi") <= F.col("lo")
    q = q.withColumns({"lo": F.when(bad, F.col("min")).otherwise(F.col("lo")), "hi": F.when(bad, F.col("max")).otherwise(F.col("hi"))})
    q = q.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))).select(*HAND_KEYS, "lo", "hi")
    if shear is None:
        return q
    parts = both.select(*HAND_KEYS, F.explode(F.concat("shear_x", "shear_y")).alias("x")).where(~F.isnan("x"))
    mag = exact_quantiles(parts, HAND_KEYS, F.abs("x"), {"shear_mag": 0.99})
    return q.join(mag.drop("n"), HAND_KEYS, "left").withColumn("shear_mag", F.coalesce("shear_mag", F.lit(1.0)))


def task_scale_fit(tactile: DataFrame, tasks: DataFrame, *, frames: int | None = None, values: int | None = None, min_episodes: int = 3, seed: int = SEED) -> DataFrame:
    """Scale per task (P99.9 of value minus pad baseline) and, with a null task, the default.

    ``tasks``: recording_id, task (null where unnamed). Tasks seen in fewer than
    ``min_episodes`` recordings are left out. ``frames`` per hand and ``values`` per pad sample.
    """
    sampled = tactile if frames is None else seeded_sample(tactile, HAND_KEYS, ["sample_idx"], frames, seed=seed)
    cells = sampled.select(*HAND_KEYS, "pad", "sample_idx", F.posexplode("force").alias("cell", "x"))
    cells = cells.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    if values is not None:
        ids = ["recording_id", "hand", "pad", "sample_idx", "cell"]
        w = Window.partitionBy("recording_id", "hand", "pad").orderBy(hash_order(ids, seed), "sample_idx", "cell")
        cells = cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= values)
    base = measured(exact_quantiles(cells, ["hand", "pad"], F.col("x"), {"base": 0.05}).drop("n"))
    dev = cells.join(base, ["hand", "pad"]).join(tasks.select("recording_id", "task"), "recording_id", "left")
    dev = dev.select("recording_id", "task", (F.col("x") - F.col("base")).alias("d"))
    named = dev.where("task IS NOT NULL")
    count = named.groupBy("task").agg(F.count_distinct("recording_id").alias("n_episodes"))
    per = exact_quantiles(named, ["task"], F.col("d"), {"scale": 0.999}).drop("n")
    per = per.join(count.where(F.col("n_episodes") >= min_episodes), "task")
    total = exact_quantiles(dev, [], F.col("d"), {"scale": 0.999}).drop("n")
    out = per.unionByName(total, allowMissingColumns=True)
    return out.withColumn("scale", F.greatest("scale", F.lit(MIN_SCALE)))


def task_scale_coverage(tasks: DataFrame, scales: DataFrame) -> DataFrame:
    """Share of recordings whose task has its own scale."""
    known = scales.where("task IS NOT NULL").select("task", F.lit(1).alias("_hit"))
    return tasks.join(known, "task", "left").agg(
        F.count("_hit").alias("matched"), F.count("*").alias("total"), (F.count("_hit") / F.count("*")).alias("match_rate"))


def broadcast_lookup(tactile: DataFrame, tasks: DataFrame, scales: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add ``base`` by (hand, pad) and ``scale`` by task, the default where the task is unknown.

    The small tables are counted before they are broadcast.
    """
    scales = measured(scales)
    default = scales.where("task IS NULL").select("scale").scalar()
    t = tasks.join(scales.where("task IS NOT NULL").select("task", "scale"), "task", "left")
    t = t.select("recording_id", F.coalesce(F.col("scale"), default).alias("scale"))
    return tactile.join(measured(t), "recording_id", "left").join(measured(baselines.select("hand", "pad", "base")), ["hand", "pad"], "left")


def tactile_activity(tactile: DataFrame, norm: DataFrame) -> DataFrame:
    """Per recording and hand: mean cell variance over pads and the share of frames in contact."""
    cells = tactile.select(*HAND_KEYS, "pad", F.posexplode("force").alias("cell", "x"))
    var = cells.groupBy(*HAND_KEYS, "pad", "cell").agg(F.var_pop("x").alias("v"))
    var = var.groupBy(*HAND_KEYS, "pad").agg(F.avg("v").alias("v")).groupBy(*HAND_KEYS).agg(F.avg("v").alias("variance"))
    j = tactile.join(measured(norm.select("hand", "pad", "base", "scale", "threshold")), ["hand", "pad"])
    # A pad is in contact when its largest cell is.
    hit = (F.array_max("force") - F.col("base")) / F.col("scale") > F.col("threshold")
    frames = j.groupBy(*HAND_KEYS, "sample_idx").agg(F.max(hit.cast("int")).alias("hit"))
    rate = frames.groupBy(*HAND_KEYS).agg(F.avg("hit").alias("contact_rate"), F.count("*").alias("n_frames"))
    return var.join(rate, HAND_KEYS)
