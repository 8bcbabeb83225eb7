"""Which rows of a recording may be used: windows, intervals, commands, frame maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.operators.asof import asof_causal
from trajq.plans.lineage import lookup_join
from trajq.plans.ordered import BUCKET, HOUR_NS, bucket_start, fill

# Freshness limits and command range.
CMD_AGE_NS = 150_000_000
TACTILE_AGE_NS = 50_000_000
CAMERA_TOL_NS = 17_500_000
EPOCH_TOL_NS = 2_000
MOTOR_RANGE = (0, 1000)
SECOND_NS = 1_000_000_000


def trial_window_filter(rows: DataFrame, trials: DataFrame, keys: Sequence[str], *, t: str = "t_ns", task: str | None = None, label: str | None = "success") -> DataFrame:
    """Rows inside their trial: ``engaged_ns <= t < released_ns``, wanted label and task."""
    ok = F.lit(True)
    if label is not None:
        ok = ok & (F.col("label") == label)
    if task is not None:
        ok = ok & (F.col("task") == task)
    j = lookup_join(rows, trials.where(ok).select(*keys, "engaged_ns", "released_ns"), keys, by=F.col(t))
    return j.where((F.col(t) >= F.col("engaged_ns")) & (F.col(t) < F.col("released_ns"))).select(*rows.columns)


def _interval_buckets(intervals: DataFrame, start: str, end: str, size: int) -> DataFrame:
    span = F.sequence(bucket_start(F.col(start), size), bucket_start(F.col(end), size), F.lit(size).cast("bigint"))
    return intervals.where(F.col(end) >= F.col(start)).withColumn(BUCKET, F.explode(span))


def interval_join(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], *, t: str = "t_ns", start: str = "start_ns", end: str = "end_ns", size: int = SECOND_NS) -> DataFrame:
    """Samples with every closed interval that contains them.

    Both sides meet on ``(keys, time bucket)``, a hash join whose keys stay small however long
    the recording is; integer time.
    """
    left = samples.withColumn(BUCKET, bucket_start(F.col(t), size))
    right = _interval_buckets(intervals, start, end, size)
    j = left.join(right, [*keys, BUCKET])
    return j.where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop(BUCKET)


def frame_range_filter(frames: DataFrame, ranges: DataFrame | None, keys: Sequence[str], *, t: str = "frame_index", start: str = "start", end: str = "end", size: int = 1000, path: str | None = None, success: str | None = None) -> DataFrame:
    """Frames inside any half-open range of their episode; without ranges all; paths matching ``success``."""
    if success is not None:
        frames = frames.where(F.col(path).rlike(success))
    if ranges is None:
        return frames
    left = frames.withColumn(BUCKET, bucket_start(F.col(t), size)).alias("l")
    right = _interval_buckets(ranges.withColumn(end, F.col(end) - 1), start, end, size).alias("r")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, BUCKET)]
    cond += [F.col(f"l.{t}") >= F.col(f"r.{start}"), F.col(f"l.{t}") <= F.col(f"r.{end}")]
    return left.join(right, cond, "left_semi").drop(BUCKET)


def row_to_episode(rows: DataFrame, episodes: DataFrame, *, index: str = "index", size: int = 1_000_000) -> DataFrame:
    """Episode of each global row by the episodes' ``[from_index, to_index)``."""
    bounds = episodes.select(F.col("from_index").alias(index), F.lit(0).alias("_kind"), F.struct("episode_index", "to_index", "from_index").alias("_ep"))
    marked = rows.withColumn("_kind", F.lit(1)).unionByName(bounds, allowMissingColumns=True)
    marked = fill(marked, [], [index, "_kind"], {"_at": F.col("_ep")}, size=size)
    inside = F.col(index) < F.col("_at.to_index")
    return marked.where((F.col("_kind") == 1) & inside).select(
        *rows.columns, F.col("_at.episode_index").alias("episode_index"), (F.col(index) - F.col("_at.from_index")).alias("frame_index")
    )


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose listed columns (numbers or arrays) are finite throughout."""
    ok = F.lit(True)
    for c in cols:
        is_array = dict(df.dtypes)[c].startswith("array")
        ok = ok & (F.coalesce(F.forall(c, finite), F.lit(False)) if is_array else finite(F.col(c)))
    return df.where(ok)


def command_validate(arm: Column, hand: Column, *, dims: int = 6) -> Column:
    """True for two finite vectors of ``dims`` with every motor value in range."""
    lo, hi = MOTOR_RANGE
    ok = (F.size(arm) == dims) & (F.size(hand) == dims) & F.forall(arm, finite)
    return F.coalesce(ok & F.forall(hand, lambda x: finite(x) & (x >= lo) & (x <= hi)), F.lit(False))


def mapped_index_check(ticks: DataFrame, frames: DataFrame, key: str, *, src: str = "src_idx", epoch: str | None = None, t: str = "t_ns", tol_ns: int = CAMERA_TOL_NS) -> DataFrame:
    """Join ticks to frames by stored index: ``in_range``, ``frame_gap``, ``epoch_ok``, ``within``.

    Equi-join on (recording, frame index): rows of one recording spread over all tasks.
    """
    f = frames.select(key, F.col("frame_index").alias(src), F.col("t_ns").alias("_ft"))
    j = ticks.join(f, [key, src], "left")
    gap = F.col(t) - F.col("_ft")
    same = F.abs(F.col(epoch) - F.col("_ft")) <= EPOCH_TOL_NS if epoch else F.lit(True)
    return j.withColumns({
        "in_range": F.col("_ft").isNotNull(),
        "frame_gap": gap,
        "epoch_ok": F.coalesce(same, F.lit(False)),
        "within": F.coalesce(F.abs(gap) <= tol_ns, F.lit(False)),
    }).drop("_ft")


def usable_rows(
    ticks: DataFrame,
    trials: DataFrame,
    arm_cmd: DataFrame,
    hand_cmd: DataFrame,
    glove: DataFrame,
    cameras: Mapping[str, DataFrame],
    *,
    key: str = "recording_id",
    clutch: str = "clutch",
    cmd_age: int = CMD_AGE_NS,
    tactile_age: int = TACTILE_AGE_NS,
    camera_tol: int = CAMERA_TOL_NS,
    label: str | None = "success",
    size: int = HOUR_NS,
) -> DataFrame:
    """One boolean per reason and ``usable`` for every grid tick.

    ``ticks``: key, row, t_ns, clutch, ``src_idx_<cam>``, ``valid_<cam>``. ``arm_cmd`` and
    ``glove``: key, t_ns, sample_idx; ``hand_cmd``: key, t_cmd_ns, t_host_ns, sample_idx.
    The three as-of lookups share one shuffle.
    """
    none = F.lit(None).cast("bigint")
    samples = (
        arm_cmd.select(key, F.lit("arm").alias("stream"), "t_ns", none.alias("issued"), "sample_idx")
        .unionByName(hand_cmd.select(
            key, F.lit("hand").alias("stream"), F.greatest("t_cmd_ns", "t_host_ns").alias("t_ns"),
            F.col("t_cmd_ns").alias("issued"), "sample_idx"))
        .unionByName(glove.select(key, F.lit("glove").alias("stream"), "t_ns", none.alias("issued"), "sample_idx"))
    )
    r = asof_causal(ticks, samples, [key], ["arm", "hand", "glove"], payload=("issued", "sample_idx"), size=size)
    t = trials.where(F.col("label") == label) if label is not None else trials
    r = lookup_join(r, t.select(key, "engaged_ns", "released_ns"), [key], "left", by=F.col("t_ns"))
    within = lambda age, limit: F.coalesce(age.between(0, limit), F.lit(False))
    flags = {
        "in_trial": F.coalesce((F.col("t_ns") >= F.col("engaged_ns")) & (F.col("t_ns") < F.col("released_ns")), F.lit(False)),
        "engaged": F.coalesce(F.col(clutch), F.lit(False)),
        "arm_fresh": within(F.col("age_arm"), cmd_age),
        "hand_fresh": within(F.col("age_hand"), cmd_age) & within(F.col("t_ns") - F.col("last_hand.issued"), cmd_age),
        "glove_fresh": within(F.col("age_glove"), tactile_age),
    }
    r = r.withColumns(flags)
    for cam, frames in cameras.items():
        r = mapped_index_check(r, frames, key, src=f"src_idx_{cam}", tol_ns=camera_tol)
        r = r.withColumn(f"camera_{cam}", F.coalesce(F.col(f"valid_{cam}"), F.lit(False)) & F.col("within"))
        r = r.drop("in_range", "frame_gap", "epoch_ok", "within")
        flags[f"camera_{cam}"] = None
    usable = F.lit(True)
    for f in flags:
        usable = usable & F.col(f)
    return r.withColumn("usable", usable).select(
        *ticks.columns, *flags, "usable",
        F.col("last_arm.sample_idx").alias("arm_idx"), F.col("last_hand.sample_idx").alias("hand_idx"),
        F.col("last_glove.sample_idx").alias("glove_idx"),
    )
