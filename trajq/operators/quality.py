"""Integrity, signal loss, noise and verdicts of recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.functions.layout import FINGERS, PARTS, part_of_slot
from trajq.functions.text import fixed
from trajq.operators.rows import SECOND_NS, interval_join
from trajq.operators.tactile import HAND_KEYS, ZERO_FLOOR, relative, visible_force
from trajq.operators.windows import interval_diff, segments
from trajq.plans.lineage import checkpoint, lookup_join, single
from trajq.plans.ordered import HOUR_NS
from trajq.plans.quantiles import exact_quantiles

# Fixed values.
LOSS_FINGERS = ("thumb", "index", "middle", "ring")
MIN_CONFIRMED = 2
MIN_SAMPLES = 3
MIN_NOISE_S = 0.3
CAMERA_GAP = 2.5
GLOVE_GAP = 3.0
FRAME_SLACK = 2
DURATION_SPREAD_S = 1.0
PREFIX_LENGTH = 8
SEVERITY = {"PASS": 0, "REVIEW": 1, "REJECT": 2}


def whole(x: Column) -> Column:
    """Number text without decimals, half-even."""
    return F.rint(x).cast("bigint").cast("string")


def one_digit(x: Column) -> Column:
    return fixed(x, 1)


def integrity_check(
    cameras: DataFrame, frame_counts: DataFrame, gloves: DataFrame, recordings: DataFrame, streams: Sequence[str],
    hands: Sequence[str] = ("left", "right"), *, key: str = "recording_id", size: int = HOUR_NS, spread_s: float = DURATION_SPREAD_S,
) -> DataFrame:
    """Readable issues per recording, in stream order (an empty list is clean).

    ``cameras``: key, stream, t_ns; ``frame_counts``: key, stream, n_frames (negative: unreadable);
    ``gloves``: key, hand, t_ns; ``recordings``: key.
    """
    def gaps(df: DataFrame, group: str, factor: float) -> DataFrame:
        # Used by both quantile passes and the final count: written once instead of three times sorted.
        d = checkpoint(interval_diff(df.select(key, group, "t_ns"), [key, group], "t_ns", size=size))
        med = exact_quantiles(d, [key, group], F.col("dt"), {"med": 0.5}).drop("n")
        d = lookup_join(d, med, [key, group], "left", by=F.col("t_ns"))
        big = F.col("dt") > F.col("med") * factor
        return d.groupBy(key, group).agg(
            F.count("*").alias("rows"), F.min("t_ns").alias("t0"), F.max("t_ns").alias("t1"), F.first("med").alias("med"),
            F.count(F.when(big, 1)).alias("n_big"), F.max(F.when(big, F.col("dt"))).alias("max_big"),
            F.min(F.when(big, F.col("t_ns") - F.col("dt"))).alias("at_big"),
        )

    wanted = recordings.select(key, F.explode(F.array(*[F.lit(s) for s in streams])).alias("stream"))
    cam = wanted.join(gaps(cameras, "stream", CAMERA_GAP), [key, "stream"], "left").join(frame_counts, [key, "stream"], "left")
    missing = F.col("rows").isNull() | F.col("n_frames").isNull()
    s = F.col("stream")
    diff = F.col("n_frames") - F.col("rows")
    count_text = F.when(F.col("n_frames") < 0, F.concat(s, F.lit(": could not read the frame count (unreadable video?)"))).when(
        F.abs(diff) > FRAME_SLACK,
        F.format_string("%s: video has %d frames vs %d timestamp rows (diff %d)", s, F.col("n_frames"), F.col("rows"), diff))
    gap_text = F.when(F.col("n_big") > 0, F.concat(
        s, F.lit(": "), F.col("n_big").cast("string"), F.lit(" abnormal frame interval(s), max "), whole(F.col("max_big") / 1e6),
        F.lit("ms (median "), whole(F.col("med") / 1e6), F.lit("ms), first at t="), one_digit((F.col("at_big") - F.col("t0")) / 1e9), F.lit("s")))
    texts = F.when(missing, F.array(F.concat(s, F.lit(": missing file")))).otherwise(F.array_compact(F.array(count_text, gap_text)))
    order = F.array_position(F.array(*[F.lit(x) for x in streams]), s)
    cam = cam.select(key, order.alias("o"), texts.alias("texts"), s.alias("stream"), F.when(~missing, (F.col("t1") - F.col("t0")) / 1e9).alias("dur"))
    glove = recordings.select(key, F.explode(F.array(*[F.lit(h) for h in hands])).alias("hand"))
    glove = glove.join(gaps(gloves, "hand", GLOVE_GAP), [key, "hand"], "left")
    h = F.col("hand")
    glove_text = F.when(F.col("rows").isNull(), F.array(F.concat(h, F.lit("_hand: missing file")))).when(
        F.col("n_big") > 0,
        F.array(F.concat(h, F.lit("_hand tactile: "), F.col("n_big").cast("string"), F.lit(" gap(s), longest "), whole(F.col("max_big") / 1e6), F.lit("ms"))),
    ).otherwise(F.array().cast("array<string>"))
    place = F.array_position(F.array(*[F.lit(x) for x in hands]), h) + len(streams) + 1
    rows = cam.unionByName(glove.select(key, place.alias("o"), glove_text.alias("texts")), allowMissingColumns=True)
    # One row per stream and hand: the list per recording is short.
    per = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("o", "texts", "stream", "dur"))).alias("l"),
        F.count("dur").alias("n_dur"), (F.max("dur") - F.min("dur")).alias("spread"),
    )
    pick = lambda lo, hi: F.flatten(F.transform(F.filter("l", lambda x: (x["o"] >= lo) & (x["o"] <= hi)), lambda x: x["texts"]))
    lengths = F.array_join(F.transform(
        F.filter("l", lambda x: x["dur"].isNotNull()), lambda x: F.concat(x["stream"], F.lit("="), one_digit(x["dur"]), F.lit("s"))), ", ")
    spread = F.when((F.col("n_dur") > 1) & (F.col("spread") > spread_s), F.array(F.concat(F.lit("stream durations differ: "), lengths))).otherwise(
        F.array().cast("array<string>"))
    issues = F.concat(pick(1, len(streams)), spread, pick(len(streams) + 1, len(streams) + len(hands) + 1))
    return per.select(key, issues.alias("issues"), F.size(issues).alias("n_issues"))


def duration_stats(durations: DataFrame, *, duration: str = "duration", cap: float = 30.0) -> DataFrame:
    """Number, min, median, mean, p90, max, total and the share over the cap; one row."""
    d = F.col(duration)
    q = single(exact_quantiles(durations, [], d, {"median": 0.5, "p90": 0.9}))
    a = durations.where(d.isNotNull()).agg(
        F.count("*").alias("n"), F.min(d).alias("min"), F.avg(d).alias("mean"), F.max(d).alias("max"), F.sum(d).alias("total"),
        F.count(F.when(d > cap, 1)).alias("n_over"), F.avg((d > cap).cast("double")).alias("share_over"))
    return a.withColumns({"median": q["median"], "p90": q["p90"]})


def duration_histogram(durations: DataFrame, *, duration: str = "duration", width: float = 5.0, cap: float = 30.0) -> DataFrame:
    """Recordings per fixed-width bucket from 0, flagged when the bucket starts at or over the cap."""
    lo = F.floor(F.col(duration) / width) * width
    return durations.where(F.col(duration).isNotNull()).groupBy(lo.alias("lo")).agg(F.count("*").alias("n")).withColumn("over_cap", F.col("lo") >= cap)


def recording_durations(samples: DataFrame, meta: DataFrame, *, key: str = "recording_id", stream: str = "rgb_head") -> DataFrame:
    """Length from the camera stream, else the positive duration of the metadata, else no row."""
    span = samples.where(F.col("stream") == stream).groupBy(key).agg(
        F.when(F.count("*") >= 2, (F.max("t_ns") - F.min("t_ns")) / 1e9).alias("_d"))
    j = meta.select(key, F.col("duration").alias("_m")).join(span, key, "full")
    return j.select(key, F.coalesce("_d", F.when(F.col("_m") > 0, F.col("_m"))).alias("duration")).where("duration IS NOT NULL")


def hand_frames(tactile: DataFrame, *, floor: float = ZERO_FLOOR) -> DataFrame:
    """One row per hand and common frame (time from the hand's first sample): force per part, their total, and whether any taxel is visible."""
    t = tactile.withColumns({"_p": part_of_slot(F.col("pad")), "_f": visible_force(F.col("force"), floor)})
    part = lambda p: F.coalesce(F.max(F.when(F.col("_p") == p, F.col("_f"))), F.lit(0.0))
    f = t.groupBy(*HAND_KEYS, "sample_idx").agg(
        F.first("t_ns").alias("t_ns"), F.max((F.array_max("force") >= floor).cast("int")).alias("_v"), *[part(p).alias(p) for p in PARTS])
    total = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    return relative(f.withColumns({"visible": F.col("_v") == 1, "total": total}).drop("_v"), tactile)


def loss_check(frames: DataFrame, contacts: DataFrame, *, size: int = SECOND_NS) -> DataFrame:
    """Confirmed fingers silent during their grasp, classed hard / weak / suspect.

    ``contacts``: recording_id, hand, contact_id, start_ns, end_ns, confirmed, skip (uncertain),
    object. Only the four loss fingers are judged, on at least three samples.
    """
    ever = frames.groupBy(*HAND_KEYS).agg(*[F.max(f).alias(f"_e_{f}") for f in LOSS_FINGERS])
    judged = contacts.where(~F.coalesce("skip", F.lit(False)))
    j = interval_join(frames.select(*HAND_KEYS, "t_ns", *LOSS_FINGERS), judged, HAND_KEYS, size=size)
    ids = [*HAND_KEYS, "contact_id"]
    per = j.groupBy(*ids).agg(
        F.count("*").alias("_n"), *[F.max(f).alias(f) for f in LOSS_FINGERS],
        *[F.first(c).alias(c) for c in ("start_ns", "end_ns", "confirmed", "object")]).where(F.col("_n") >= MIN_SAMPLES)
    per = per.join(ever, HAND_KEYS)
    conf = F.filter("confirmed", lambda f: f.isin(*LOSS_FINGERS))
    peak = F.create_map(*[x for f in LOSS_FINGERS for x in (F.lit(f), F.col(f))])
    alive = F.create_map(*[x for f in LOSS_FINGERS for x in (F.lit(f), F.col(f"_e_{f}"))])
    per = per.withColumns({"confirmed": conf, "_peak": peak, "_alive": alive})
    per = per.withColumn("_silent", F.filter("confirmed", lambda f: F.element_at("_peak", f) == 0))
    per = per.withColumn("whole_hand", (F.size("_silent") == F.size("confirmed")) & (F.size("confirmed") >= MIN_CONFIRMED))
    rows = per.select(*ids, "start_ns", "end_ns", "object", "confirmed", "whole_hand", "_alive", F.posexplode("_silent").alias("pos", "finger"))
    dead = F.element_at("_alive", F.col("finger")) == 0
    kind = F.when(dead & F.col("whole_hand"), "hard").when(dead, "weak").otherwise("suspect")
    return rows.withColumn("kind", kind).drop("_alive")


def noise_candidates(frames: DataFrame, free: DataFrame, *, min_s: float = MIN_NOISE_S, size: int = SECOND_NS, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Visible-signal spans inside free intervals: start, end (s), dur, peak total force, lit fingers.

    ``free``: recording_id, hand, free_id, start_ns, end_ns.
    """
    keys = [*HAND_KEYS, "free_id"]
    j = interval_join(frames, free, HAND_KEYS, size=size)
    enough = j.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_SAMPLES).drop("_n")
    aggs = {"peak": ("max", F.col("total")), **{f"_m_{f}": ("max", F.col(f)) for f in FINGERS}}
    seg = segments(
        j.join(enough, keys, "left_semi"), keys, "sample_idx", F.col("visible"), F.col("t_ns"), min_len=round(min_s * 1e9),
        size=rows_per_bucket, agg=aggs)
    return seg.select(
        *keys, (F.col("start") / 1e9).alias("start"), (F.col("end") / 1e9).alias("end"),
        ((F.col("end") - F.col("start")) / 1e9).alias("dur"), "peak",
        F.array_compact(F.array(*[F.when(F.col(f"_m_{f}") > 0, f) for f in FINGERS])).alias("fingers"))


def _object_name() -> Column:
    return F.coalesce(F.nullif(F.col("object"), F.lit("")), F.lit("object"))


def hand_verdict(hands: DataFrame, faults: DataFrame, contacts: DataFrame, losses: DataFrame, free: DataFrame, noise: DataFrame) -> DataFrame:
    """Verdict, reason and noise share of each hand.

    ``hands``: recording_id, hand; ``faults``: hard_fault; ``noise``: candidates with ``dur`` and
    ``confirmed`` (null or absent answer counts as not noise).
    """
    span = F.concat(_object_name(), F.lit(" at "), one_digit(F.col("start_ns") / 1e9), F.lit("-"), one_digit(F.col("end_ns") / 1e9), F.lit("s"))
    hard = F.concat(F.col("finger"), F.lit(" touches "), span, F.lit(" and every visually confirmed finger in that grasp is silent"))
    others = F.array_join(F.filter("confirmed", lambda f: f != F.col("finger")), ", ")
    tail = F.when(others == "", F.lit("and it is the only confirmed finger in that grasp (weak evidence)")).otherwise(
        F.concat(F.lit("while "), others, F.lit(" in the same grasp respond")))
    weak = F.concat(F.col("finger"), F.lit(" reported touching "), span, F.lit(" but is silent, "), tail)
    item = F.struct("contact_id", "pos", F.when(F.col("kind") == "hard", hard).otherwise(weak).alias("text"))
    text = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item))), lambda x: x["text"]), "; ")
    by_hand = losses.groupBy(*HAND_KEYS).agg(
        F.count(F.when(F.col("kind") == "hard", 1)).alias("n_hard"), F.count(F.when(F.col("kind") == "weak", 1)).alias("n_weak"),
        F.count(F.when(F.col("kind") == "suspect", 1)).alias("n_suspect"), text("hard").alias("_hard"), text("weak").alias("_weak"))
    touched = contacts.groupBy(*HAND_KEYS).agg(F.lit(True).alias("_touched"))
    quiet = free.groupBy(*HAND_KEYS).agg(F.sum(F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)) / 1e9).alias("_free"))
    loud = noise.where("confirmed").groupBy(*HAND_KEYS).agg(F.sum("dur").alias("_noise"), F.count("*").alias("_seg"))
    h = hands.join(faults, HAND_KEYS, "left")
    for extra in (touched, by_hand, quiet, loud):
        h = h.join(extra, HAND_KEYS, "left")
    dead = F.coalesce("hard_fault", F.lit(False)) & F.coalesce("_touched", F.lit(False))
    zero = F.lit(0.0)
    free_s, noise_s = F.coalesce("_free", zero), F.coalesce("_noise", zero)
    reason = F.when(dead, F.lit("[tier0] all 15 pads silent for the whole episode (vision confirms this hand grasps something)")).when(
        F.col("n_hard") > 0, F.concat(F.lit("tactile loss (high confidence): "), F.col("_hard"))).when(
        F.col("n_weak") > 0, F.concat(F.lit("possible tactile loss (needs human check): "), F.col("_weak"))).otherwise(F.lit(""))
    return h.select(
        *HAND_KEYS,
        F.when(dead | (F.col("n_hard") > 0), "REJECT").when(F.col("n_weak") > 0, "REVIEW").otherwise("PASS").alias("verdict"),
        reason.alias("reason"),
        F.when(dead, 0).otherwise(F.coalesce("_seg", F.lit(0))).alias("noise_seg"),
        F.when(dead, zero).otherwise(free_s).alias("free_s"),
        F.when(dead, zero).otherwise(noise_s).alias("noise_s"),
        F.when(~dead & (free_s > 1e-6), noise_s / free_s).otherwise(zero).alias("noise_pct"),
    )


def episode_verdict(hands: DataFrame, errors: DataFrame | None = None, *, key: str = "recording_id") -> DataFrame:
    """Worst hand per recording with its noise figures; recordings in ``errors`` become ERROR rows."""
    rank = F.element_at(F.create_map(*[x for v, s in SEVERITY.items() for x in (F.lit(v), F.lit(s))]), F.col("verdict"))
    names = F.array(*[F.lit(v) for v in SEVERITY])
    e = hands.groupBy(key).agg(
        F.max(rank).alias("_r"), F.sum("noise_seg").alias("noise_seg"), F.sum("noise_s").alias("noise_s"), F.sum("free_s").alias("free_s"))
    e = e.select(key, F.get(names, F.col("_r")).alias("verdict"), "noise_seg", "noise_s", "free_s",
                 (F.col("noise_s") * 100 / F.greatest(F.col("free_s"), F.lit(1e-6))).alias("noise_pct"), F.lit(None).cast("string").alias("error"))
    if errors is None:
        return e
    bad = errors.select(key, F.lit("ERROR").alias("verdict"), "error")
    return e.join(errors, key, "left_anti").unionByName(bad, allowMissingColumns=True)


def verdict_summary(results: DataFrame) -> DataFrame:
    """Counts per verdict, share decided automatically and share to review; one row."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    return results.agg(
        F.count("*").alias("n"), *[n(v).alias(v.lower()) for v in ("REJECT", "REVIEW", "PASS", "ERROR")],
        (100 * (n("REJECT") + n("PASS")) / F.count("*")).alias("auto_pct"), (100 * n("REVIEW") / F.count("*")).alias("review_pct"))


def review_list(episodes: DataFrame, hands: DataFrame, losses: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row per flagged finger (or flagged hand without one) of REJECT and REVIEW recordings."""
    tier = episodes.where(F.col("verdict").isin("REJECT", "REVIEW")).select("recording_id", F.col("verdict").alias("tier"))
    flagged = hands.where(F.col("verdict") != "PASS").select(*HAND_KEYS, F.col("verdict").alias("hand_verdict"), "reason")
    items = losses.where(F.col("kind").isin("hard", "weak")).select(*HAND_KEYS, "finger", "object", "start_ns", "end_ns")
    peak = peaks.groupBy(*HAND_KEYS).agg(F.array_sort(F.collect_list(F.struct(part_rank(F.col("part")).alias("o"), "part", "peak"))).alias("_p"))  # 6 parts
    text = F.array_join(F.transform("_p", lambda x: F.concat(x["part"], F.lit("="), fixed(x["peak"], 2))), ", ")
    out = tier.join(flagged, "recording_id").join(items, HAND_KEYS, "left").join(peak, HAND_KEYS, "left")
    caption = F.concat_ws(" ", F.col("recording_id").cast("string"), F.col("hand"), F.col("finger"), F.lit("claimed on"), F.col("object"), F.lit("but silent"))
    return out.select("tier", *HAND_KEYS, "hand_verdict", "reason", "finger", (F.col("start_ns") / 1e9).alias("start"), (F.col("end_ns") / 1e9).alias("end"),
                      F.when(F.col("finger").isNotNull(), caption).alias("caption"), text.alias("peaks"))


def part_rank(part: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PARTS]), part)


def noise_report(episodes: DataFrame) -> DataFrame:
    """Recordings with confirmed noise, largest share of free time first."""
    noisy = episodes.where(F.coalesce("noise_seg", F.lit(0)) > 0)
    return noisy.select("recording_id", "verdict", "noise_seg", "noise_s", "noise_pct").orderBy(F.desc("noise_pct"), F.desc("recording_id"))


def prefix_clash(recordings: DataFrame, *, name: str = "name", length: int = PREFIX_LENGTH) -> DataFrame:
    """Name prefixes that occur more than once."""
    return recordings.groupBy(F.substring(name, 1, length).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")
