"""Queries for grids, as-of joins and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.data import (
    FIVE_DAYS_NS, GRID_SQL, HALF_DAY_NS, NEAR_SQL, STREAMS, STREAMS_SQL, WINDOW_SQL, streams,
)
from trajq.operators import asof, gate

QUERIES, SQL = {}, {}
STEP = dict(step_ns=float(HALF_DAY_NS), size=FIVE_DAYS_NS)
TOL_NS = 3 * 86_400_000_000_000


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def near(spark, sf):
    return gate.aligned_ticks(streams(spark, sf), STREAMS, **STEP)


@query("common_window", f"WITH {STREAMS_SQL}, {WINDOW_SQL} SELECT * FROM win")
def _(spark, sf):
    return gate.common_window(streams(spark, sf))


@query("uniform_grid", f"WITH {STREAMS_SQL}, {GRID_SQL} SELECT * FROM grid")
def _(spark, sf):
    w = gate.common_window(streams(spark, sf)).where((F.col("n_streams") == 5) & (F.col("min_samples") >= 2))
    return gate.uniform_grid(w.where(F.col("end_ns") - F.col("start_ns") >= 1_000_000_000), **STEP)


@query("asof_nearest_grid", f"WITH {STREAMS_SQL}, {NEAR_SQL} SELECT recording_id, tick, stream, idx AS sample_idx, gap FROM near")
def _(spark, sf):
    out = asof.melt_nearest(near(spark, sf), ["recording_id", "tick"], STREAMS)
    return out.select("recording_id", "tick", "stream", F.col("near.sample_idx").alias("sample_idx"), "gap")


@query("asof_nearest_late", f"""WITH {STREAMS_SQL}, {NEAR_SQL}
  SELECT recording_id, tick, stream,
    CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t_ns - pt < nt - t_ns) THEN pi ELSE ni END AS sample_idx,
    CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t_ns - pt < nt - t_ns) THEN t_ns - pt ELSE nt - t_ns END AS gap
  FROM both_""")
def _(spark, sf):
    wide = gate.aligned_ticks(streams(spark, sf), STREAMS, tie="later", **STEP)
    out = asof.melt_nearest(wide, ["recording_id", "tick"], STREAMS)
    return out.select("recording_id", "tick", "stream", F.col("near.sample_idx").alias("sample_idx"), "gap")


# Clicks ask for the newest purchase / error of the same recording.
CAUSAL_SQL = f"""WITH {STREAMS_SQL}
  SELECT q.recording_id, q.sample_idx AS tick, s.sample_idx AS source_idx, q.t_ns - s.t_ns AS age_ns%s
  FROM (SELECT * FROM streams WHERE stream = 'click') q
  ASOF LEFT JOIN (SELECT * FROM streams WHERE stream = 'purchase') s
  ON q.recording_id = s.recording_id AND q.t_ns >= s.t_ns"""


def _causal(spark, sf, max_age):
    s = streams(spark, sf)
    ticks = s.where("stream = 'click'").select("recording_id", "t_ns", F.col("sample_idx").alias("tick"))
    src = s.where("stream = 'purchase'")
    out = asof.asof_causal(ticks, src, ["recording_id"], ["purchase"], max_age=max_age, size=FIVE_DAYS_NS)
    return out.select(
        "recording_id", "tick", F.col("last_purchase.sample_idx").alias("source_idx"),
        F.col("age_purchase").alias("age_ns"), F.col("valid_purchase").alias("valid"),
    )


@query("asof_causal", CAUSAL_SQL % f", coalesce(q.t_ns - s.t_ns <= {TOL_NS}, false) AS valid")
def _(spark, sf):
    return _causal(spark, sf, TOL_NS)


@query("asof_last_ever", CAUSAL_SQL % ", s.t_ns IS NOT NULL AS valid")
def _(spark, sf):
    return _causal(spark, sf, None)


@query("asof_two_clock", f"""WITH {STREAMS_SQL},
  cmd AS (SELECT recording_id, sample_idx, t_ns AS issued, t_ns + (sample_idx % 7) * 3600000000000 AS logged
          FROM streams WHERE stream = 'purchase'),
  src AS (SELECT recording_id, greatest(issued, logged) AS t_ns, max({{'i': issued, 's': sample_idx}}) AS m FROM cmd GROUP BY 1, 2),
  j AS (SELECT q.recording_id, q.sample_idx AS tick, s.m.s AS source_idx, q.t_ns - s.t_ns AS age_ns, q.t_ns - s.m.i AS issue_age_ns
        FROM (SELECT * FROM streams WHERE stream = 'click') q ASOF LEFT JOIN src s
        ON q.recording_id = s.recording_id AND q.t_ns >= s.t_ns)
  SELECT *, coalesce(age_ns <= {TOL_NS} AND issue_age_ns BETWEEN 0 AND {TOL_NS}, false) AS valid FROM j""")
def _(spark, sf):
    s = streams(spark, sf)
    ticks = s.where("stream = 'click'").select("recording_id", "t_ns", F.col("sample_idx").alias("tick"))
    cmd = s.where("stream = 'purchase'").select(
        "recording_id", "stream", "sample_idx", F.col("t_ns").alias("issued"),
        (F.col("t_ns") + (F.col("sample_idx") % 7) * F.lit(3_600_000_000_000)).alias("logged"),
    ).withColumn("t_ns", asof.two_clock("issued", "logged"))
    out = asof.asof_causal(
        ticks, cmd, ["recording_id"], ["purchase"], max_age=TOL_NS, payload=("issued", "sample_idx"), size=FIVE_DAYS_NS)
    issue_age = F.col("t_ns") - F.col("last_purchase.issued")
    return out.select(
        "recording_id", "tick", F.col("last_purchase.sample_idx").alias("source_idx"), F.col("age_purchase").alias("age_ns"),
        issue_age.alias("issue_age_ns"),
        (F.col("valid_purchase") & F.coalesce(issue_age.between(0, TOL_NS), F.lit(False))).alias("valid"),
    )


GATE_SQL = f"""WITH {STREAMS_SQL}, {NEAR_SQL},
g AS (SELECT recording_id, tick, max(gap) AS allgap FROM near GROUP BY 1, 2),
st AS (SELECT recording_id, count(*) AS n_grid, avg((allgap <= {TOL_NS})::INT) AS al,
       sum((allgap > {2 * TOL_NS})::INT)::BIGINT AS n_holes, max(allgap) AS mx FROM g GROUP BY 1),
ws AS (SELECT recording_id, arg_max(stream, {{'g': round_even(mg / 1e5, 0), 'o': -ord}}) AS worst FROM
       (SELECT recording_id, stream, ord, max(gap) AS mg FROM near GROUP BY 1, 2, 3) GROUP BY 1),
cv AS (SELECT recording_id, min(a) FILTER (stream IN ('click', 'view')) <= min(a) FILTER (stream = 'purchase') + {TOL_NS}
        AND max(b) FILTER (stream IN ('click', 'view')) >= max(b) FILTER (stream = 'purchase') - {TOL_NS} AS cover FROM per GROUP BY 1),
ms AS (SELECT r.recording_id, list(n.stream ORDER BY n.ord) FILTER (coalesce(p.n, 0) < 2) AS missing
       FROM (SELECT DISTINCT recording_id FROM streams) r CROSS JOIN names n
       LEFT JOIN per p ON p.recording_id = r.recording_id AND p.stream = n.stream GROUP BY 1),
r AS (SELECT ms.recording_id, st.n_grid, al, n_holes, n_holes / n_grid AS hole, mx / 1e6 AS mxms, worst, cover, missing
      FROM ms LEFT JOIN st USING (recording_id) LEFT JOIN ws USING (recording_id) LEFT JOIN cv USING (recording_id)),
t AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'missing timestamp streams: [' ||
        list_aggregate(list_transform(missing, lambda x: '''' || x || ''''), 'string_agg', ', ') || ']'
      WHEN n_grid IS NULL THEN 'common time window shorter than 1 s'
      ELSE concat_ws('; ',
        CASE WHEN al < 0.8 THEN 'aligned ' || printf('%.1f', al * 100) || '% < 80% (tol {TOL_NS / 1e6:.1f}ms; worst stream: ' || worst || ')' END,
        CASE WHEN hole > 0.05 THEN 'holes ' || printf('%.2f', hole * 100) || '% > 5% (' || n_holes || ' ticks; worst stream: ' || worst || ')' END,
        CASE WHEN mxms > {2 * TOL_NS / 1e6} THEN 'blackout: worst gap ' || printf('%.0f', mxms) || 'ms > {2 * TOL_NS / 1e6:.0f}ms (worst stream: ' || worst || ')' END,
        CASE WHEN NOT cover THEN 'glove window does not cover the camera window' END) END AS reason FROM r)
SELECT recording_id, n_grid IS NOT NULL AS judged, n_grid IS NOT NULL AND reason = '' AS passed,
  CASE WHEN reason = '' THEN 'ok' ELSE reason END AS reason, coalesce(n_grid, 0) AS n_grid,
  coalesce(round(al, 4), 0) AS aligned_frac, coalesce(n_holes, -1) AS n_holes, round(hole, 4) AS hole_frac,
  round(mxms, 1) AS maxgap_ms, CASE WHEN n_grid IS NOT NULL THEN worst END AS worst_stream,
  CASE WHEN n_grid IS NOT NULL THEN cover END AS cover FROM t"""


def gate_result(spark, sf):
    return gate.sync_gate(
        streams(spark, sf), STREAMS, cover_by=("click", "view"), cover_of="purchase", tol_ns=TOL_NS, frame_ns=2 * TOL_NS,
        min_aligned=0.8, max_hole_share=0.05, max_gap_ns=2 * TOL_NS, slack_ns=TOL_NS, **STEP)


@query("sync_gate", GATE_SQL)
def _(spark, sf):
    return gate_result(spark, sf)


@query("stream_gaps", f"""WITH {STREAMS_SQL}, {NEAR_SQL},
  l AS (SELECT *, lag(idx) OVER (PARTITION BY recording_id, stream ORDER BY tick) AS was FROM near)
  SELECT recording_id, stream, avg((idx = was)::INT) AS dup, sum((gap > {TOL_NS})::INT)::BIGINT AS holes,
    round(max(gap) / 1e6, 1) AS maxgap_ms FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return gate.stream_gaps(near(spark, sf), STREAMS, frame_ns=TOL_NS, size=1000)


@query("stream_passrate", f"""WITH {STREAMS_SQL}, {NEAR_SQL},
  p AS (SELECT recording_id, stream, count(*) AS n_ticks, max(gap) / 1e6 AS max_error_ms,
        sum((gap > {TOL_NS})::INT)::BIGINT AS invalid_frames, avg((gap <= {TOL_NS})::INT) AS pass_rate FROM near GROUP BY 1, 2)
  SELECT *, min(pass_rate) OVER (PARTITION BY recording_id) >= 0.7 AND n_ticks > 10 AS accepted FROM p""")
def _(spark, sf):
    return gate.stream_passrate(near(spark, sf), STREAMS, tol_ns=TOL_NS, min_rate=0.7, min_ticks=10)


_PIVOT = ", ".join(
    f"max(idx) FILTER (stream = '{s}') AS {s}_index, max(gap) FILTER (stream = '{s}') AS {s}_error_ns, "
    f"bool_or(gap <= {TOL_NS}) FILTER (stream = '{s}') AS {s}_within_tolerance" for s in STREAMS)


@query("resample_streams", f"WITH {STREAMS_SQL}, {NEAR_SQL} SELECT recording_id, tick, t_ns, {_PIVOT} FROM near GROUP BY 1, 2, 3")
def _(spark, sf):
    return gate.resample_streams(near(spark, sf), STREAMS, tol_ns=TOL_NS)


@query("pass_rate_by_task", f"""WITH q AS ({GATE_SQL}), t AS (SELECT 'task_' || (recording_id % 12) AS task, passed FROM q)
  SELECT task, sum(passed::INT)::BIGINT AS n_pass, count(*) AS n_total, grouping(task)::BIGINT AS is_total FROM t GROUP BY ROLLUP (task)""")
def _(spark, sf):
    r = gate_result(spark, sf).withColumn("task", F.concat(F.lit("task_"), (F.col("recording_id") % 12).cast("string")))
    return gate.pass_rate_by_task(r)
