"""As-of joins of time-stamped samples onto ticks.

One shuffle by ``(keys, time bucket)``: ticks and the samples of all streams are sorted together
once in each direction, every stream is a conditional last/first over that order, and the newest
sample of earlier buckets is carried in from the bucket summaries. There is no tick x stream
product, no range join, and no task that sees a whole recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.plans.ordered import BUCKET, HOUR_NS, bucket_start, dealt


def asof_wide(
    ticks: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    streams: Sequence[str],
    *,
    t: str = "t_ns",
    stream: str = "stream",
    payload: Sequence[str] = ("sample_idx",),
    size: int = HOUR_NS,
    at_or_before: bool = False,
    forward: bool = True,
) -> DataFrame:
    """Add to each tick, per stream, structs ``prev_<stream>`` and ``next_<stream>`` of (t, payload).

    ``prev`` is the last sample ``< t`` (``<= t`` with ``at_or_before``) and ``next`` the first
    sample ``>= t``. Among samples of equal time ``prev`` is the last and ``next`` the first in
    payload order. Both are null where there is none. With an empty payload they are plain times
    (long window buffers instead of structs, for callers that need only the gaps).
    """
    keys = list(keys)
    tick_cols = [c for c in ticks.columns if c not in (*keys, t)]
    sample = F.struct(F.col(t), *[F.col(c) for c in payload]) if payload else F.col(t)
    u = ticks.select(*keys, t, F.struct(*tick_cols).alias("_tick") if tick_cols else F.struct(F.col(t)).alias("_tick"))
    u = u.unionByName(
        samples.select(*keys, t, F.col(stream).alias("_stream"), sample.alias("_s")), allowMissingColumns=True
    )
    is_tick = F.col("_tick").isNotNull()
    number = F.coalesce(*[F.when(F.col("_stream") == s, i) for i, s in enumerate(streams)])
    u = u.withColumn("_stream", number).withColumn(BUCKET, bucket_start(F.col(t), size)).withColumn(
        "_kind", F.when(is_tick, F.lit(1 if at_or_before else 0)).otherwise(F.lit(0 if at_or_before else 1))
    )
    part = Window.partitionBy(*keys, BUCKET)
    order = [t, "_kind", "_s"] if payload else [t, "_kind"]
    past = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    coming = part.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    of = {s: F.when(F.col("_stream") == i, F.col("_s")) for i, s in enumerate(streams)}
    local = {f"_p_{s}": F.last(v, ignorenulls=True).over(past) for s, v in of.items()}
    if forward:
        local |= {f"_n_{s}": F.last(v, ignorenulls=True).over(coming) for s, v in of.items()}
    rows = dealt(u, keys).withColumns(local).where(is_tick)

    edges = [F.max(v).alias(f"_hi_{s}") for s, v in of.items()]
    if forward:
        edges += [F.min(v).alias(f"_lo_{s}") for s, v in of.items()]
    summary = u.groupBy(*keys, BUCKET).agg(*edges)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_hi_{s}", ignorenulls=True).over(before).alias(f"_cp_{s}") for s in streams]
    if forward:
        carried += [F.last(f"_lo_{s}", ignorenulls=True).over(after).alias(f"_cn_{s}") for s in streams]
    out = rows.join(summary.select(*keys, BUCKET, *carried), [*keys, BUCKET], "left")
    cols = [F.coalesce(f"_p_{s}", f"_cp_{s}").alias(f"prev_{s}") for s in streams]
    if forward:
        cols += [F.coalesce(f"_n_{s}", f"_cn_{s}").alias(f"next_{s}") for s in streams]
    return out.select(*keys, t, *[F.col("_tick")[c].alias(c) for c in tick_cols], *cols)


def nearest(streams: Sequence[str], *, t: str = "t_ns", tie: str = "earlier", plain: bool = False) -> dict[str, Column]:
    """Per stream the nearer of prev/next as ``near_<stream>``: (sample struct, gap)."""
    out = {}
    for s in streams:
        p, n = F.col(f"prev_{s}"), F.col(f"next_{s}")
        dp = F.col(t) - (p if plain else p[t])
        dn = (n if plain else n[t]) - F.col(t)
        closer = dp <= dn if tie == "earlier" else dp < dn
        use_prev = n.isNull() | (p.isNotNull() & closer)
        out[f"near_{s}"] = F.when(use_prev, p).otherwise(n)
        out[f"gap_{s}"] = F.when(use_prev, dp).otherwise(dn)
    return out


def asof_nearest(
    ticks: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    streams: Sequence[str],
    *,
    t: str = "t_ns",
    tie: str = "earlier",
    payload: Sequence[str] = ("sample_idx",),
    size: int = HOUR_NS,
    stream: str = "stream",
) -> DataFrame:
    """Nearest sample of each stream per tick: ``near_<s>`` struct and ``gap_<s>``."""
    wide = asof_wide(ticks, samples, keys, streams, t=t, payload=payload, size=size, stream=stream)
    drop = [f"{p}_{s}" for s in streams for p in ("prev", "next")]
    return wide.withColumns(nearest(streams, t=t, tie=tie, plain=not payload)).drop(*drop)


def melt_nearest(wide: DataFrame, ids: Sequence[str], streams: Sequence[str]) -> DataFrame:
    """One row per tick and stream: ids, ``stream``, ``near`` struct, ``gap``."""
    items = F.array(
        *[
            F.struct(F.lit(s).alias("stream"), F.col(f"near_{s}").alias("near"), F.col(f"gap_{s}").alias("gap"))
            for s in streams
        ]
    )
    return wide.select(*ids, F.inline(items))


def asof_causal(
    ticks: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    streams: Sequence[str],
    *,
    max_age: int | None = None,
    t: str = "t_ns",
    payload: Sequence[str] = ("sample_idx",),
    size: int = HOUR_NS,
    stream: str = "stream",
) -> DataFrame:
    """Newest sample at or before each tick: ``last_<s>`` struct, ``age_<s>``, ``valid_<s>``."""
    wide = asof_wide(
        ticks, samples, keys, streams, t=t, payload=payload, size=size, stream=stream, at_or_before=True, forward=False
    )
    out = {}
    for s in streams:
        age = F.col(t) - F.col(f"last_{s}")[t]
        ok = F.col(f"last_{s}").isNotNull() & (age >= 0)
        out[f"age_{s}"] = age
        out[f"valid_{s}"] = ok if max_age is None else F.coalesce(ok & (age <= max_age), F.lit(False))
    return wide.withColumnsRenamed({f"prev_{s}": f"last_{s}" for s in streams}).withColumns(out)


def two_clock(issued: str, logged: str, *, t: str = "t_ns") -> Column:
    """Time at which a command is usable: both issued and logged."""
    return F.greatest(issued, logged).alias(t)
