"""Common window, uniform grid and the sync gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.functions.text import fixed
from trajq.operators.asof import asof_nearest, melt_nearest
from trajq.plans.ordered import BUCKET, HOUR_NS, bucket_start, fill

# Gate defaults.
GRID_HZ = 30.0
FRAME_NS = 33_333_333
ALIGN_TOL_NS = 17_500_000
ALIGN_SHARE = 0.95
MAX_HOLE_SHARE = 0.01
MAX_GAP_NS = 66_000_000
MIN_WINDOW_NS = 1_000_000_000
COVER_SLACK_NS = 50_000_000
MIN_TICKS = 50


def common_window(
    samples: DataFrame, keys: Sequence[str] = ("recording_id",), *, t: str = "t_ns", stream: str = "stream"
) -> DataFrame:
    """Per recording: window shared by all its streams (latest first, earliest last sample)."""
    per = samples.groupBy(*keys, stream).agg(
        F.min(t).alias("first_ns"), F.max(t).alias("last_ns"), F.count("*").alias("n")
    )
    return per.groupBy(*keys).agg(
        F.max("first_ns").alias("start_ns"),
        F.min("last_ns").alias("end_ns"),
        F.count("*").alias("n_streams"),
        F.min("n").alias("min_samples"),
    )


def uniform_grid(
    windows: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    step_ns: float = 1e9 / GRID_HZ,
    size: int = HOUR_NS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Ticks ``start + rint(k * step)`` below the end: keys, ``tick``, ``t_ns``.

    A long recording is first cut into time buckets that are spread over the cluster, and only
    then expanded, so no task makes all the ticks of one recording.
    """
    start, end = F.col("start_ns"), F.col("end_ns")
    first = bucket_start(start, size)
    w = windows.where(end > start).withColumn(BUCKET, F.explode(F.sequence(first, bucket_start(end, size), F.lit(size).cast("bigint"))))
    w = w.repartition(*keys, BUCKET)
    lo = F.greatest(F.floor((F.col(BUCKET) - start) / F.lit(step_ns)) - 1, F.lit(0)).cast("bigint")
    hi = F.ceil((F.least(F.col(BUCKET) + size, end) - start) / F.lit(step_ns)).cast("bigint") + 1
    ticks = w.select(*keys, *carry, BUCKET, "start_ns", "end_ns", F.explode(F.sequence(lo, hi)).alias("tick"))
    ticks = ticks.withColumn("t_ns", start + F.rint(F.col("tick") * F.lit(step_ns)).cast("bigint"))
    inside = (F.col("t_ns") >= F.col(BUCKET)) & (F.col("t_ns") < F.col(BUCKET) + size) & (F.col("t_ns") < end)
    return ticks.where(inside).select(*keys, *carry, "tick", "t_ns")


def aligned_ticks(
    samples: DataFrame,
    streams: Sequence[str],
    keys: Sequence[str] = ("recording_id",),
    *,
    step_ns: float = 1e9 / GRID_HZ,
    size: int = HOUR_NS,
    min_window_ns: int = MIN_WINDOW_NS,
    payload: Sequence[str] = ("sample_idx",),
    tie: str = "earlier",
) -> DataFrame:
    """Grid ticks of every recording that has all streams, with the nearest sample of each."""
    win = common_window(samples, keys).where(
        (F.col("n_streams") == len(streams)) & (F.col("min_samples") >= 2)
        & (F.col("end_ns") - F.col("start_ns") >= min_window_ns)
    )
    grid = uniform_grid(win, keys, step_ns=step_ns, size=size)
    return asof_nearest(grid, samples, keys, streams, payload=payload, size=size, tie=tie)


def share(x: Column, digits: int) -> Column:
    """Percentage text with a fixed number of digits."""
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def list_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))


def sync_gate(
    samples: DataFrame,
    streams: Sequence[str],
    *,
    key: str = "recording_id",
    cover_by: Sequence[str] = (),
    cover_of: str | None = None,
    missing_files: DataFrame | None = None,
    labels: dict[str, str] | None = None,
    step_ns: float = 1e9 / GRID_HZ,
    frame_ns: int = FRAME_NS,
    tol_ns: int = ALIGN_TOL_NS,
    min_aligned: float = ALIGN_SHARE,
    max_hole_share: float = MAX_HOLE_SHARE,
    max_gap_ns: int = MAX_GAP_NS,
    min_window_ns: int = MIN_WINDOW_NS,
    slack_ns: int = COVER_SLACK_NS,
    size: int = HOUR_NS,
) -> DataFrame:
    """PASS/FAIL per recording with the measured shares and the joined reasons.

    ``missing_files`` has ``key`` and ``missing ARRAY<STRING>``; ``cover_by`` are the streams
    whose span must cover that of ``cover_of``. Recordings without a single sample do not appear
    unless ``missing_files`` lists them.
    """
    labels = labels or {s: s for s in streams}
    per = samples.where(F.col("stream").isin(list(streams))).groupBy(key).agg(
        *[e for s in streams for e in _span(s)]
    )
    if missing_files is not None:
        per = per.join(missing_files.select(key, F.col("missing").alias("missing_files")), key, "full")
    else:
        per = per.withColumn("missing_files", F.array().cast("array<string>"))
    ok = {s: F.coalesce(F.col(f"_n_{s}"), F.lit(0)) >= 2 for s in streams}
    per = per.withColumns({
        "missing_files": F.coalesce("missing_files", F.array().cast("array<string>")),
        "missing_streams": F.array_compact(F.array(*[F.when(~ok[s], F.lit(labels[s])) for s in streams])),
        "start_ns": F.greatest(*[F.col(f"_a_{s}") for s in streams]) if len(streams) > 1 else F.col(f"_a_{streams[0]}"),
        "end_ns": F.least(*[F.col(f"_b_{s}") for s in streams]) if len(streams) > 1 else F.col(f"_b_{streams[0]}"),
    })
    if cover_by and cover_of:
        lo = F.least(*[F.col(f"_a_{s}") for s in cover_by]) if len(cover_by) > 1 else F.col(f"_a_{cover_by[0]}")
        hi = F.greatest(*[F.col(f"_b_{s}") for s in cover_by]) if len(cover_by) > 1 else F.col(f"_b_{cover_by[0]}")
        cover = (lo <= F.col(f"_a_{cover_of}") + slack_ns) & (hi >= F.col(f"_b_{cover_of}") - slack_ns)
    else:
        cover = F.lit(True)
    per = per.withColumn("cover", cover)
    usable = (F.size("missing_streams") == 0) & (F.col("end_ns") - F.col("start_ns") >= min_window_ns)
    grid = uniform_grid(per.where(usable).select(key, "start_ns", "end_ns"), [key], step_ns=step_ns, size=size)
    near = asof_nearest(grid, samples, [key], streams, size=size, payload=())
    gaps = [F.col(f"gap_{s}") for s in streams]
    near = near.withColumn("allgap", F.greatest(*gaps) if len(gaps) > 1 else gaps[0])
    stats = near.groupBy(key).agg(
        F.count("*").alias("n_grid"),
        F.avg((F.col("allgap") <= tol_ns).cast("double")).alias("_aligned"),
        F.sum((F.col("allgap") > frame_ns).cast("bigint")).alias("n_holes"),
        F.max("allgap").alias("_max"),
        *[F.max(f"gap_{s}").alias(f"_m_{s}") for s in streams],
    )
    # Worst stream: largest gap rounded to 0.1 ms, the first stream on a tie.
    worst = F.greatest(*[
        F.struct(F.rint(F.col(f"_m_{s}") / 1e5).alias("g"), F.lit(-i).alias("o"), F.lit(s).alias("s"), F.lit(labels[s]).alias("l"))
        for i, s in enumerate(streams)
    ]) if len(streams) > 1 else F.struct(F.lit(0.0).alias("g"), F.lit(0).alias("o"), F.lit(streams[0]).alias("s"), F.lit(labels[streams[0]]).alias("l"))
    r = per.join(stats, key, "left").withColumns({
        "_worst": worst, "_hole": F.col("n_holes") / F.col("n_grid"), "_gapms": F.col("_max") / 1e6,
    })
    files = F.when(F.size("missing_files") > 0, F.concat(F.lit("missing video files: "), list_text(F.col("missing_files"))))
    worst_text = F.concat(F.lit("worst stream: "), F.col("_worst.l"), F.lit(")"))
    full = F.concat_ws(
        "; ",
        files,
        F.when(F.col("_aligned") < min_aligned, F.concat(
            F.lit("aligned "), share(F.col("_aligned"), 1), F.lit(f" < {min_aligned:.0%} (tol {tol_ns / 1e6:.1f}ms; "), worst_text)),
        F.when(F.col("_hole") > max_hole_share, F.concat(
            F.lit("holes "), share(F.col("_hole"), 2), F.lit(f" > {max_hole_share:.0%} ("), F.col("n_holes").cast("string"),
            F.lit(" ticks; "), worst_text)),
        F.when(F.col("_max") > max_gap_ns, F.concat(
            F.lit("blackout: worst gap "), F.rint("_gapms").cast("bigint").cast("string"), F.lit(f"ms > {max_gap_ns / 1e6:.0f}ms ("), worst_text)),
        F.when(~F.col("cover"), F.lit("glove window does not cover the camera window")),
    )
    short = F.lit("common time window shorter than 1 s")
    gone = F.concat_ws("; ", F.concat(F.lit("missing timestamp streams: "), list_text(F.col("missing_streams"))), files)
    reason = F.when(F.size("missing_streams") > 0, gone).when(F.col("n_grid").isNull(), short).otherwise(full)
    return r.withColumn("_reason", reason).select(
        key,
        F.col("n_grid").isNotNull().alias("judged"),
        ((F.col("_reason") == "") & F.col("n_grid").isNotNull()).alias("passed"),
        F.when(F.col("_reason") == "", "ok").otherwise(F.col("_reason")).alias("reason"),
        F.coalesce("n_grid", F.lit(0)).alias("n_grid"),
        F.coalesce(F.round("_aligned", 4), F.lit(0.0)).alias("aligned_frac"),
        F.coalesce("n_holes", F.lit(-1)).cast("bigint").alias("n_holes"),
        F.round("_hole", 4).alias("hole_frac"),
        F.round("_gapms", 1).alias("maxgap_ms"),
        F.when(F.col("n_grid").isNotNull(), F.col("_worst.s")).alias("worst_stream"),
        F.when(F.col("n_grid").isNotNull(), F.col("cover")).alias("cover"),
    )


def _span(s: str) -> list[Column]:
    here = F.col("stream") == s
    return [
        F.min(F.when(here, F.col("t_ns"))).alias(f"_a_{s}"),
        F.max(F.when(here, F.col("t_ns"))).alias(f"_b_{s}"),
        F.count(F.when(here, F.col("t_ns"))).alias(f"_n_{s}"),
    ]


def stream_gaps(near: DataFrame, streams: Sequence[str], *, key: str = "recording_id", frame_ns: int = FRAME_NS, size: int = 1_000_000) -> DataFrame:
    """Per recording and stream: share of ticks repeating the previous sample, holes, largest gap."""
    prev = fill(
        near, [key], "tick", {f"_was_{s}": F.col(f"near_{s}.sample_idx") for s in streams}, size=size, inclusive=False
    )
    aggs = []
    for s in streams:
        same = (F.col(f"near_{s}.sample_idx") == F.col(f"_was_{s}")).cast("double")
        aggs += [
            F.avg(same).alias(f"d_{s}"),
            F.sum((F.col(f"gap_{s}") > frame_ns).cast("bigint")).alias(f"h_{s}"),
            F.round(F.max(f"gap_{s}") / 1e6, 1).alias(f"g_{s}"),
        ]
    wide = prev.groupBy(key).agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(s).alias("stream"), F.col(f"d_{s}").alias("dup"), F.col(f"h_{s}").alias("holes"), F.col(f"g_{s}").alias("maxgap_ms"))
        for s in streams
    ])
    return wide.select(key, F.inline(items))


def stream_passrate(
    near: DataFrame, streams: Sequence[str], *, key: str = "recording_id", tol_ns: int = ALIGN_TOL_NS,
    min_rate: float = ALIGN_SHARE, min_ticks: int = MIN_TICKS,
) -> DataFrame:
    """Per stream: largest error, invalid frames and pass rate; ``accepted`` asks all streams and length."""
    aggs = [F.count("*").alias("n_ticks")]
    for s in streams:
        aggs += [
            F.max(f"gap_{s}").alias(f"m_{s}"),
            F.sum((F.col(f"gap_{s}") > tol_ns).cast("bigint")).alias(f"i_{s}"),
            F.avg((F.col(f"gap_{s}") <= tol_ns).cast("double")).alias(f"p_{s}"),
        ]
    wide = near.groupBy(key).agg(*aggs)
    rates = [F.col(f"p_{s}") for s in streams]
    low = F.least(*rates) if len(rates) > 1 else rates[0]
    wide = wide.withColumn("accepted", (low >= min_rate) & (F.col("n_ticks") > min_ticks))
    items = F.array(*[
        F.struct(F.lit(s).alias("stream"), (F.col(f"m_{s}") / 1e6).alias("max_error_ms"), F.col(f"i_{s}").alias("invalid_frames"), F.col(f"p_{s}").alias("pass_rate"))
        for s in streams
    ])
    return wide.select(key, "n_ticks", "accepted", F.inline(items))


def resample_streams(near: DataFrame, streams: Sequence[str], *, key: str = "recording_id", tol_ns: int = ALIGN_TOL_NS) -> DataFrame:
    """One row per tick: per stream the chosen sample, its error and whether it is within tolerance."""
    cols = []
    for s in streams:
        cols += [
            F.col(f"near_{s}.sample_idx").alias(f"{s}_index"),
            F.col(f"gap_{s}").alias(f"{s}_error_ns"),
            (F.col(f"gap_{s}") <= tol_ns).alias(f"{s}_within_tolerance"),
        ]
    return near.select(key, "tick", "t_ns", *cols)


def pass_rate_by_task(results: DataFrame, *, task: str = "task", passed: str = "passed") -> DataFrame:
    """Passes and totals per task, and overall in the row with a null task."""
    return results.rollup(task).agg(
        F.sum(F.col(passed).cast("bigint")).alias("n_pass"), F.count("*").alias("n_total"), F.grouping(task).cast("bigint").alias("is_total")
    )


__all__ = ["common_window", "uniform_grid", "aligned_ticks", "sync_gate", "stream_gaps", "stream_passrate",
           "resample_streams", "pass_rate_by_task", "melt_nearest"]
