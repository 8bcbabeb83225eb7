"""Runs, gap bridging, look-ahead windows and episode numbering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.plans.lineage import lookup_join
from trajq.plans.ordered import ROWS_PER_BUCKET, fill, global_index, neighbours, running_sum, runs

# Run length, horizon, frame rate, episodes per chunk.
MIN_RUN = 50
HORIZON = 50
FPS = 30.0
EPISODES_PER_CHUNK = 1000


def contiguous_runs(df: DataFrame, keys: Sequence[str], index: str, valid: Column, *, min_length: int = MIN_RUN, size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows of runs of consecutive valid rows at least ``min_length`` long."""
    return runs(df.where(valid), keys, index, size=size, rows=True).where(F.col("run_len") >= min_length)


def segments(
    df: DataFrame, keys: Sequence[str], index: str, on: Column, t: Column, *, max_step: int = 2, min_len: float = 0.0,
    size: int = ROWS_PER_BUCKET, agg: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Time spans of the ``on`` samples, short gaps bridged: ``start, end`` and the aggregates."""
    spans = {"start": ("min", t), "end": ("max", t), **(agg or {})}
    out = runs(df.where(on), keys, index, max_step=max_step, size=size, agg=spans)
    return out.where(F.col("end") - F.col("start") >= min_len)


def bridge_gaps(df: DataFrame, keys: Sequence[str], index: str, valid: Column, fillable: Column, max_gap: int, *, size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``valid`` after bridging and ``added``: gaps of at most ``max_gap`` fillable rows between valid rows.

    ``index`` is dense per key. A gap is looked at only ``max_gap`` rows to each side.
    """
    base = df.withColumn("_v", F.coalesce(valid, F.lit(False)))
    if max_gap <= 0:
        return base.withColumn("added", F.lit(False)).withColumn("valid", F.col("_v")).drop("_v")
    base = base.withColumn("_bad", ~F.col("_v") & ~F.coalesce(fillable, F.lit(False)))
    rows, part = neighbours(base, keys, index, back=max_gap + 1, ahead=max_gap + 1, size=size)
    before = Window.partitionBy(*part).orderBy(F.col(index)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*part).orderBy(F.col(index).desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda flag, w: F.last(F.when(F.col(flag), F.col(index)), ignorenulls=True).over(w)
    rows = rows.withColumns({
        "_pv": seen("_v", before), "_nv": seen("_v", after), "_pb": seen("_bad", before), "_nb": seen("_bad", after),
    })
    clean = (F.col("_pb").isNull() | (F.col("_pb") < F.col("_pv"))) & (F.col("_nb").isNull() | (F.col("_nb") > F.col("_nv")))
    fill_it = ~F.col("_v") & clean & (F.col("_nv") - F.col("_pv") - 1 <= max_gap)
    rows = rows.withColumn("added", F.coalesce(fill_it, F.lit(False))).where("_core")
    keep = [c for c in df.columns if c != "valid"]
    return rows.select(*keep, (F.col("_v") | F.col("added")).alias("valid"), "added")


def hold_last(engaged: Column, fresh: Column, fresh_ok: Column, last: Column, measured: Column, measured_ok: Column) -> tuple[Column, Column]:
    """Target of an arm and whether it is usable.

    Engaged: the fresh command. Otherwise the last command ever given, and before the first
    command the measured pose.
    """
    value = F.when(engaged, fresh).when(last.isNotNull(), last).otherwise(measured)
    ok = F.when(engaged, fresh_ok).otherwise(last.isNotNull() | measured_ok)
    return value, F.coalesce(ok, F.lit(False))


def action_horizon(df: DataFrame, keys: Sequence[str], index: str, value: Column, *, horizon: int = HORIZON, name: str = "chunk", size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the next ``horizon`` values of each row, the episode's last one repeated, and ``<name>_is_pad``."""
    rows, part = neighbours(df.withColumn("_x", value), keys, index, ahead=horizon - 1, size=size)
    w = Window.partitionBy(*part).orderBy(index).rowsBetween(0, horizon - 1)
    rows = rows.withColumn("_a", F.collect_list("_x").over(w)).where("_core")
    n = F.size("_a")
    return rows.select(
        *df.columns,
        F.concat("_a", F.array_repeat(F.element_at("_a", -1), F.lit(horizon) - n)).alias(name),
        F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: i >= n).alias(f"{name}_is_pad"),
    )


def delta_offsets(df: DataFrame, keys: Sequence[str], index: str, value: Column, offsets: Mapping[str, int], *, size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the value at each frame offset, clamped to the episode, and ``<name>_is_pad``.

    ``index`` is dense per key. Buckets grow to the longest offset, so every offset is exact.
    """
    d = df.withColumn("_x", value)
    cols = {}
    back = max([-o for o in offsets.values() if o < 0], default=0)
    ahead = max([o for o in offsets.values() if o > 0], default=0)
    rows, part = neighbours(d, keys, index, back=back, ahead=ahead, size=size)
    w = Window.partitionBy(*part).orderBy(index)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = {}
    for n, o in offsets.items():
        at = F.lead(F.struct("_x"), o).over(w) if o >= 0 else F.lag(F.struct("_x"), -o).over(w)
        edge = F.last(F.struct("_x")).over(whole) if o >= 0 else F.first(F.struct("_x")).over(whole)
        local[f"_at_{n}"], local[f"_edge_{n}"] = at, edge
        cols[n] = F.when(F.col(f"_at_{n}").isNull(), F.col(f"_edge_{n}._x")).otherwise(F.col(f"_at_{n}._x"))
        cols[f"{n}_is_pad"] = F.col(f"_at_{n}").isNull()
    rows = rows.withColumns(local).where("_core")
    order = [c for n in offsets for c in (n, f"{n}_is_pad")]
    return rows.select(*df.columns, *[cols[c].alias(c) for c in order])


def action_from_state_shift(df: DataFrame, keys: Sequence[str], index: str, state: Column, frames: int, *, name: str = "action", size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Action of a frame is the state ``frames`` later, or the episode's last state."""
    return delta_offsets(df, keys, index, state, {name: frames}, size=size).drop(f"{name}_is_pad")


def episode_offsets(episodes: DataFrame, *, index: str = "episode_index", length: str = "length", size: int = 100_000) -> DataFrame:
    """Add the half-open global row range ``[from_index, to_index)`` of each episode."""
    out = running_sum(episodes, [], index, {"to_index": F.col(length)}, size=size)
    return out.withColumn("from_index", F.col("to_index") - F.col(length))


def renumber(episodes: DataFrame, order: Sequence[str], *, length: str = "length") -> DataFrame:
    """Dense ``episode_index`` in source order with global row ranges and chunk number."""
    numbered = global_index(episodes, order, "episode_index")
    out = episode_offsets(numbered, length=length)
    return out.withColumn("chunk", F.floor(F.col("episode_index") / EPISODES_PER_CHUNK))


def renumber_frames(frames: DataFrame, episodes: DataFrame, keys: Sequence[str], *, index: str = "frame_index") -> DataFrame:
    """Frames with their new episode, time stamp and global row index."""
    out = lookup_join(frames, episodes.select(*keys, "episode_index", "from_index"), keys, by=F.col(index))
    return out.withColumns({
        "timestamp": (F.col(index).cast("float") / F.lit(FPS).cast("float")).cast("float"),
        "index": F.col("from_index") + F.col(index),
    }).drop("from_index")


def interval_diff(df: DataFrame, keys: Sequence[str], t: str, *, name: str = "dt", size: int = ROWS_PER_BUCKET, tie: Sequence[str] = ()) -> DataFrame:
    """Add the time since the previous sample of the key (null for the first)."""
    prev = fill(df, keys, [t, *tie], {"_prev": F.col(t)}, size=size, inclusive=False)
    return prev.withColumn(name, F.col(t) - F.col("_prev")).drop("_prev")


def batch_center(df: DataFrame, batch: str, value: str, *, name: str = "centered") -> DataFrame:
    """Subtract the mean vector of the batch."""
    flat = df.select(batch, F.posexplode(value).alias("_i", "_x"))
    means = flat.groupBy(batch, "_i").agg(F.avg("_x").alias("_m"))
    means = means.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_mu"))  # one entry per dimension
    out = lookup_join(df, means, [batch], by=F.col(value))
    return out.withColumn(name, F.zip_with(value, "_mu", lambda x, m: x - m["_m"])).drop("_mu")


def step_stats(df: DataFrame, keys: Sequence[str], index: str, xyz: Sequence[Column], *, size: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per key: steps, their total and mean length, direction reversals and valid pairs."""
    d = df.withColumn("_p", F.array(*xyz))
    rows, part = neighbours(d, keys, index, back=2, size=size)
    w = Window.partitionBy(*part).orderBy(index)
    rows = rows.withColumns({"_p1": F.lag("_p", 1).over(w), "_p2": F.lag("_p", 2).over(w)}).where("_core")
    diff = lambda a, b: [F.col(a)[i] - F.col(b)[i] for i in range(len(xyz))]
    v, u = diff("_p", "_p1"), diff("_p1", "_p2")
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    rows = rows.select(
        *keys, F.sqrt(dot(v, v)).alias("step"), (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))).alias("_nn"), dot(u, v).alias("_uv")
    )
    ok = F.col("_nn") > 1e-6
    return rows.groupBy(*keys).agg(
        F.count("step").alias("n_steps"),
        F.sum("step").alias("path_length"),
        F.avg("step").alias("mean_step"),
        F.count(F.when(ok & (F.col("_uv") / F.col("_nn") < 0), 1)).alias("reversals"),
        F.count(F.when(ok, 1)).alias("valid_pairs"),
    )


def bridge_sweep(df: DataFrame, key: str, index: str, valid: Column, fillable: Column, gaps: Sequence[int], *, min_length: int = MIN_RUN, size: int = ROWS_PER_BUCKET) -> DataFrame:
    """For each gap limit: runs, frames, bridged rows, rows lost to short runs, runs per trajectory."""
    total, names = None, df.select(key).distinct()
    for n in gaps:
        b = bridge_gaps(df, [key], index, valid, fillable, n, size=size)
        islands = runs(b.where("valid"), [key], index, size=size, agg={"_added": ("sum", F.col("added").cast("bigint"))})
        kept = F.col("run_len") >= min_length
        first = F.min(F.when(kept, F.struct("run_start", "run_len")))
        per = islands.groupBy(key).agg(
            F.count(F.when(kept, 1)).alias("r"),
            F.coalesce(F.sum(F.when(kept, F.col("run_len"))), F.lit(0)).alias("f"),
            F.sum("run_len").alias("v"),
            F.sum("_added").alias("a"),
            F.coalesce(first["run_len"], F.lit(0)).alias("h"),
        )
        per = names.join(per, key, "left").fillna(0)
        one = per.agg(
            F.lit(n).cast("bigint").alias("max_gap"),
            F.sum("r").alias("runs"),
            F.sum("f").alias("frames"),
            F.sum("a").alias("bridged"),
            (F.sum("v") - F.sum("f")).alias("short_dropped"),
            F.min("r").alias("runs_min"),
            F.percentile("r", 0.5).alias("runs_median"),
            F.max("r").alias("runs_max"),
            F.count(F.when(F.col("r") > 1, 1)).alias("multi_run"),
            ((F.sum("f") - F.sum("h")) / F.sum("f")).alias("later_share"),
        )
        total = one if total is None else total.unionByName(one)
    return total


__all__ = ["contiguous_runs", "segments", "bridge_gaps", "hold_last", "action_horizon", "delta_offsets",
           "action_from_state_shift", "episode_offsets", "renumber", "renumber_frames", "interval_diff", "batch_center",
           "step_stats", "bridge_sweep"]
