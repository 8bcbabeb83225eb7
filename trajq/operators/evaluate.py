"""Errors of predictions, contrastive error and latent sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.functions.vectors import dot, norm
from trajq.plans.lineage import checkpoint, measured

# Slots of the scored groups, active-target threshold, ratio bands.
GROUPS = {"xyz": (10, 13), "rot6d": (13, 19), "hand": (20, 26)}
ACTIVE = 1 / 255
BANDS = (3.0, 0.3)


def baseline_rows(df: DataFrame, kind: str, *, state: str = "state", target: str = "target", mean: Column | None = None) -> DataFrame:
    """Replace ``pred`` by a baseline: zero motion (``mean`` on the hand), or holding the state."""
    if kind == "hold":
        return df.withColumn("pred", F.col(state))
    lo, hi = GROUPS["hand"]
    zero = F.transform(target, lambda v, i: F.when((i >= lo) & (i < hi), mean[i]).otherwise(F.lit(0.0)) if mean is not None else F.lit(0.0))
    return df.withColumn("pred", zero)


def chunk_errors(df: DataFrame, *, pred: str = "pred", target: str = "target", groups: Mapping[str, tuple[int, int]] = GROUPS) -> DataFrame:
    """Add per (frame, step) row: L2 over xyz, mean absolute error over rot6d and hand."""
    cut = lambda c, g: F.slice(c, groups[g][0] + 1, groups[g][1] - groups[g][0])
    diff = lambda g: F.zip_with(cut(pred, g), cut(target, g), lambda a, b: a - b)
    mae = lambda g: F.aggregate(diff(g), F.lit(0.0), lambda s, v: s + F.abs(v)) / (groups[g][1] - groups[g][0])
    return df.withColumns({"xyz_l2": norm(diff("xyz")), "rot6d_mae": mae("rot6d"), "hand_mae": mae("hand")})


def macro_micro(df: DataFrame, value: Column, *, groups: Sequence[str] = (), episode: str = "episode_index") -> DataFrame:
    """Mean over rows, mean over episode means and its standard error, per group (e.g. horizon step)."""
    per = df.groupBy(*groups, episode).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n")).where(F.col("_n") > 0)
    return per.groupBy(*groups).agg(
        (F.sum("_s") / F.sum("_n")).alias("micro"), F.avg("_m").alias("macro"), F.count("*").alias("n_episodes"), F.sum("_n").alias("n_rows"),
        F.when(F.count("*") > 1, F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("episode_se"))


def row_errors(df: DataFrame, *, pred: str = "pred", target: str = "target") -> DataFrame:
    """Add mean absolute error, mean absolute target and the active flag of a row."""
    mean_abs = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(x)
    d = df.withColumns({"error": mean_abs(F.zip_with(pred, target, lambda a, b: a - b)), "zero": mean_abs(F.col(target))})
    return d.withColumn("active", F.col("zero") > ACTIVE)


def prediction_summary(scored: DataFrame, *, episode: str = "episode_index") -> DataFrame:
    """One row: MAE, zero-prediction MAE, the active subset, and the mean over episodes."""
    on = lambda c: F.when(F.col("active"), F.col(c))
    per = scored.groupBy(episode).agg(
        F.avg("error").alias("_m"), F.sum("error").alias("e"), F.sum("zero").alias("z"), F.count("*").alias("n"),
        F.count(F.when(F.col("active"), 1)).alias("na"), F.sum(on("error")).alias("ea"), F.sum(on("zero")).alias("za"))
    return per.agg(
        F.sum("n").alias("samples"), (F.sum("e") / F.sum("n")).alias("mae"), (F.sum("z") / F.sum("n")).alias("zero_mae"),
        F.sum("na").alias("active_samples"), F.try_divide(F.sum("ea"), F.sum("na")).alias("active_mae"),
        F.try_divide(F.sum("za"), F.sum("na")).alias("active_zero_mae"), F.avg("_m").alias("macro_episode_mae"))


TILE = 1024
#: Parts that a pool's vectors are dealt into at most on each side of the matrix, while a part's stay within so many bytes.
SIDES, PART_BYTES = 16, 32 << 20


def _sides(n: Column, dims: Column, tile: int) -> Column:
    """Parts on each side of the matrix of n vectors."""
    held = F.greatest(F.lit(tile), F.floor(F.lit(PART_BYTES // 8) / F.greatest(dims, F.lit(1))))
    return F.greatest(F.least(F.lit(SIDES), F.ceil(n / tile)), F.ceil(n / held)).cast("int")


def _part_udf(temperature: float, tile: int):
    """Row and column log-sums of one part of the cosine matrix, tile by tile; nested, so executors need only numpy."""
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def sums(a, axis):
        top = a.max(axis=axis)
        return top, np.exp(a - np.expand_dims(top, axis)).sum(axis=axis)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        names = ["_pool", "id", "side", "own", "top", "total"]
        if rows.empty or cols.empty:
            return pd.DataFrame([], columns=names)
        a, b = unit(np.stack(rows["v"])), unit(np.stack(cols["v"]))
        top = [np.full(len(x), -np.inf) for x in (a, b)]
        total = [np.zeros(len(x)) for x in (a, b)]
        for i in range(0, len(a), tile):
            for j in range(0, len(b), tile):
                logits = a[i : i + tile] @ b[j : j + tile].T / temperature
                for side, at, axis in ((0, slice(i, i + tile), 1), (1, slice(j, j + tile), 0)):
                    new, n = sums(logits, axis)
                    best = np.maximum(top[side][at], new)
                    total[side][at] = total[side][at] * np.exp(top[side][at] - best) + n * np.exp(new - best)
                    top[side][at] = best
        place = {i: k for k, i in enumerate(cols["id"])}
        found = np.array([place.get(i, -1) for i in rows["id"]])
        own = np.where(found < 0, np.nan, (a * b[found]).sum(1) / temperature)
        out = [pd.DataFrame({"_pool": part["_pool"], "id": part["id"], "side": side, "own": own if side == 0 else np.nan, "top": top[side], "total": total[side]}) for side, part in ((0, rows), (1, cols))]
        return pd.concat(out)[names]

    return run


def contrastive_error(df: DataFrame, *, pool: Sequence[str] = (), z: str = "z", z_star: str = "z_star", valid: Column | None = None, temperature: float = 1.0, tile: int = TILE) -> DataFrame:
    """Half the row plus half the column cross-entropy of each valid vector within its whole pool.

    ``pool``: the caller's keys, none means one pool; ``id`` is unique in a pool. The matrix of a pool
    is cut into parts of at most ``SIDES`` by ``SIDES``; a task holds the vectors of a part's rows and columns
    (``PART_BYTES`` of each; a pool of more is cut into more parts) and ``tile`` x ``tile`` numbers at once,
    and gives one partial log-sum per row and column, which are then merged; any tile size gives the same
    errors. The work grows with the square of a pool, as the measure does; every vector is sent ``2 * SIDES``
    times at most, so the data sent grows with the rows, up to ``SIDES`` times ``PART_BYTES`` of vectors in a
    pool. Pools with fewer than two valid vectors give 0.
    """
    if not (temperature > 0 and np.isfinite(temperature)):
        raise ValueError("temperature must be finite and positive")
    kept = df if valid is None else df.where(valid)
    key = F.to_json(F.struct(*pool)) if pool else F.lit("")
    kept = checkpoint(kept.select(*pool, key.alias("_pool"), "id", F.col(z).alias("_a"), F.col(z_star).alias("_b")))
    sizes = measured(kept.groupBy("_pool").agg(F.count("*").alias("_n"), F.max(F.size("_a")).alias("_d")).select("_pool", "_n", _sides(F.col("_n"), F.col("_d"), tile).alias("_t")))
    at = kept.join(sizes, "_pool").withColumn("_own", F.pmod(F.xxhash64("id"), "_t").cast("int"))
    every = F.sequence(F.lit(0), F.col("_t") - 1)
    rows = at.select("_pool", "id", F.lit(0).alias("side"), F.col("_a").alias("v"), F.col("_own").alias("i"), F.explode(every).alias("j"))
    cols = at.select("_pool", "id", F.lit(1).alias("side"), F.col("_b").alias("v"), F.explode(every).alias("i"), F.col("_own").alias("j"))
    parts = rows.unionAll(cols).groupBy("_pool", "i", "j").applyInPandas(_part_udf(temperature, tile), "_pool string, id bigint, side int, own double, top double, total double")
    parts = parts.groupBy("_pool", "id", "side").agg(F.max("own").alias("own"), F.collect_list(F.struct("top", "total")).alias("p"))  # one entry per part
    best = F.array_max(F.transform("p", lambda x: x["top"]))
    merged = parts.withColumn("_m", best).withColumn("lse", F.col("_m") + F.log(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["top"] - F.col("_m")))))
    per = merged.groupBy("_pool", "id").agg(F.sum("lse").alias("_l"), F.max("own").alias("_o"))
    error = F.when(F.col("_n") >= 2, 0.5 * F.col("_l") - F.col("_o")).otherwise(0.0)
    return at.select(*pool, "_pool", "id", "_n").join(per, ["_pool", "id"]).select(*pool, "id", error.alias("error"))


def pair_metrics(a: Column, b: Column) -> tuple[Column, Column]:
    """Cosine and relative L2 distance of two vectors."""
    cos = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))
    rel = norm(F.zip_with(a, b, lambda x, y: x - y)) / (norm(a) + 1e-8)
    return cos, rel


def latent_sensitivity(df: DataFrame, groups: Sequence[str], *, batch: str = "batch", real: str = "z") -> DataFrame:
    """Long table per perturbation: cosine raw and centred on the batch mean, relative L2 - mean, std, n.

    ``df`` holds the unperturbed vector and one column ``z_<group>`` per perturbation, plus
    ``valid_<group>`` saying which rows count.
    """
    from trajq.operators.windows import batch_center

    centred = batch_center(df, batch, real, name="_c")
    mu = F.zip_with(real, "_c", lambda x, c: x - c)
    centred = centred.withColumn("_mu", mu)
    items = []
    for g in groups:
        z = F.col(f"z_{g}")
        cos, rel = pair_metrics(F.col(real), z)
        cos_c, _ = pair_metrics(F.col("_c"), F.zip_with(z, "_mu", lambda x, m: x - m))
        items.append(F.when(F.col(f"valid_{g}"), F.struct(F.lit(g).alias("variant"), cos.alias("cos"), cos_c.alias("cos_c"), rel.alias("rel"))))
    flat = centred.select(F.inline(F.array_compact(F.array(*items))))
    stat = [f(c).alias(f"{c}_{n}") for c in ("cos", "cos_c", "rel") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return flat.groupBy("variant").agg(F.count("*").alias("n"), *stat)


def sensitivity_ratio(stats: DataFrame, *, shuffle: str = "shuffle", swap: str = "swap", column: str = "cos_c_mean") -> DataFrame:
    """R = (1 - cos shuffle) / (1 - cos swap) and its band; one row."""
    gap = lambda g: F.greatest(F.max(F.when(F.col("variant") == g, 1 - F.col(column))), F.lit(0.0))
    has = lambda g: F.count(F.when(F.col("variant") == g, 1)) > 0
    r = stats.agg(F.when(has(shuffle) & has(swap) & (gap(swap) != 0), gap(shuffle) / F.nullif(gap(swap), F.lit(0.0))).alias("ratio"))
    hi, lo = BANDS
    band = F.when(F.col("ratio").isNull() | F.isnan("ratio"), "inconclusive").when(F.col("ratio") >= hi, "tactile").when(F.col("ratio") > lo, "mixed").otherwise("vision-language")
    return r.withColumn("band", band)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation, 0 where either side has no spread.

    ``corr`` itself divides by zero there, which is an error in ANSI mode.
    """
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx < 1e-12) | (sy < 1e-12), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), sx * sy))


def pearson(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation per key."""
    return df.groupBy(*keys).agg(correlation(x, y).alias("r"), F.count("*").alias("n"))


def ordinal_ranks(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """Add 0-based ordinal ranks ``rank_<c>`` over the table (ties in id order), by range partitioning."""
    from trajq.plans.ordered import global_index

    out = df
    for c in columns:
        out = global_index(out, [c, id_col], f"rank_{c}")
    return out


def spearman(df: DataFrame, x: str, y: str, id_col: str) -> DataFrame:
    """Pearson correlation of ordinal ranks."""
    ranked = ordinal_ranks(df, [x, y], id_col)
    return pearson(ranked, F.col(f"rank_{x}").cast("double"), F.col(f"rank_{y}").cast("double")).withColumnRenamed("r", "rho")


def holm_adjust(df: DataFrame, p: str = "p", *, order: Sequence[str] = (), family: Sequence[str] = ()) -> DataFrame:
    """Add Holm-adjusted p-values; ``family`` is one set of tests."""
    part = Window.partitionBy(*(family or [F.lit(0)]))
    w = part.orderBy(p, *order)
    m = F.count("*").over(part)
    d = df.withColumns({"_a": F.least((m - F.row_number().over(w) + 1) * F.col(p), F.lit(1.0))})
    return d.withColumn("p_holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")
