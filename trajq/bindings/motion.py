"""Queries for runs, windows, numbering, intervals and row validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.alignment import TOL_NS, near
from trajq.bindings.data import DAY_NS, FIVE_DAYS_NS, FRAMES_SQL, NEAR_SQL, STREAMS_SQL, frames, streams, table
from trajq.operators import asof, rows, windows
from trajq.plans.ordered import row_index

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def series(spark, sf):
    """Rows of a recording in time order with a validity and an engagement flag."""
    s = streams(spark, sf).select("recording_id", "sample_idx", "t_ns", "value")
    s = row_index(s, ["recording_id"], "t_ns", "idx", size=FIVE_DAYS_NS)
    return s.withColumns({"ok": F.col("value") < 60, "engaged": F.col("sample_idx") % 5 != 0})


SERIES_SQL = f"""{STREAMS_SQL},
series AS (SELECT recording_id, sample_idx, t_ns, value, row_number() OVER (PARTITION BY recording_id ORDER BY t_ns) - 1 AS idx,
           value < 60 AS ok, sample_idx % 5 <> 0 AS engaged FROM streams)"""

ISLANDS_SQL = f"""{SERIES_SQL},
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM series WHERE ok)"""


@query("contiguous_runs", f"""WITH {ISLANDS_SQL}, r AS (SELECT recording_id, idx, min(idx) OVER w AS run_start, max(idx) OVER w AS run_end,
  count(*) OVER w AS run_len FROM isl WINDOW w AS (PARTITION BY recording_id, g)) SELECT * FROM r WHERE run_len >= 5""")
def _(spark, sf):
    out = windows.contiguous_runs(series(spark, sf), ["recording_id"], "idx", F.col("ok"), min_length=5, size=16)
    return out.select("recording_id", "idx", "run_start", "run_end", "run_len")


@query("segments", f"""WITH {SERIES_SQL}, b AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS nw
  FROM series WHERE value >= 40), c AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM b),
  s AS (SELECT recording_id, min(t_ns) AS start_ns, max(t_ns) AS end_ns, count(*) AS n, max(value) AS peak FROM c GROUP BY recording_id, g)
  SELECT * FROM s WHERE end_ns - start_ns >= {DAY_NS}""")
def _(spark, sf):
    out = windows.segments(
        series(spark, sf), ["recording_id"], "idx", F.col("value") >= 40, F.col("t_ns"), min_len=DAY_NS, size=16,
        agg={"peak": ("max", F.col("value"))})
    return out.select("recording_id", F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.col("run_len").alias("n"), "peak")


def _bridged_sql(n):
    return f"""SELECT s.*, NOT s.ok AND coalesce(g.fill, false) AS added FROM series s LEFT JOIN
      (SELECT recording_id, min(idx) AS a, max(idx) AS b, bool_and(engaged) AND count(*) <= {n}
          AND min(idx) > any_value(f) AND max(idx) < any_value(l) AS fill
       FROM (SELECT x.*, idx - row_number() OVER (PARTITION BY x.recording_id ORDER BY idx) AS g, f, l FROM series x
             JOIN (SELECT recording_id, min(idx) AS f, max(idx) AS l FROM series WHERE ok GROUP BY 1) e USING (recording_id)
             WHERE NOT ok) GROUP BY recording_id, g) g
      ON s.recording_id = g.recording_id AND s.idx BETWEEN g.a AND g.b"""


@query("bridge_gaps", f"WITH {SERIES_SQL}, br AS ({_bridged_sql(3)}) SELECT recording_id, idx, ok OR added AS valid, added FROM br")
def _(spark, sf):
    out = windows.bridge_gaps(series(spark, sf), ["recording_id"], "idx", F.col("ok"), F.col("engaged"), 3, size=16)
    return out.select("recording_id", "idx", "valid", "added")


def _sweep_sql(n):
    src = f"({_bridged_sql(n)})" if n else "(SELECT *, false AS added FROM series)"
    return f"""SELECT {n}::BIGINT AS max_gap, sum(r)::BIGINT AS runs, sum(f)::BIGINT AS frames, sum(a)::BIGINT AS bridged,
      (sum(v) - sum(f))::BIGINT AS short_dropped, min(r) AS runs_min, quantile_cont(r, 0.5)::DOUBLE AS runs_median, max(r) AS runs_max,
      count(*) FILTER (r > 1) AS multi_run, (sum(f) - sum(h)) / sum(f) AS later_share
    FROM (SELECT recording_id, count(*) FILTER (n >= 5) AS r, coalesce(sum(n) FILTER (n >= 5), 0) AS f, sum(n) AS v, sum(a) AS a,
            coalesce(arg_min(n, s) FILTER (n >= 5), 0) AS h
          FROM (SELECT recording_id, g, count(*) AS n, min(idx) AS s, sum(added::INT) AS a FROM
                (SELECT *, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM {src} WHERE ok OR added)
                GROUP BY 1, 2) GROUP BY 1)"""


@query("bridge_sweep", f"WITH {SERIES_SQL} " + " UNION ALL ".join(_sweep_sql(n) for n in (0, 1, 2, 3)))
def _(spark, sf):
    return windows.bridge_sweep(
        series(spark, sf), "recording_id", "idx", F.col("ok"), F.col("engaged"), (0, 1, 2, 3), min_length=5, size=16)


@query("hold_last", f"""WITH {STREAMS_SQL}
  SELECT q.recording_id, q.sample_idx AS tick, q.sample_idx % 3 = 0 AS engaged,
    CASE WHEN q.sample_idx % 3 = 0 THEN s.value WHEN s.t_ns IS NOT NULL THEN s.value ELSE -q.value END AS target,
    CASE WHEN q.sample_idx % 3 = 0 THEN coalesce(q.t_ns - s.t_ns <= {TOL_NS}, false) ELSE s.t_ns IS NOT NULL OR q.value < 60 END AS ok
  FROM (SELECT * FROM streams WHERE stream = 'click') q
  ASOF LEFT JOIN (SELECT * FROM streams WHERE stream = 'purchase') s ON q.recording_id = s.recording_id AND q.t_ns >= s.t_ns""")
def _(spark, sf):
    s = streams(spark, sf)
    ticks = s.where("stream = 'click'").select("recording_id", "t_ns", F.col("sample_idx").alias("tick"), "value")
    j = asof.asof_causal(ticks, s.where("stream = 'purchase'"), ["recording_id"], ["purchase"], max_age=TOL_NS,
                         payload=("sample_idx", "value"), size=FIVE_DAYS_NS)
    j = j.withColumn("engaged", F.col("tick") % 3 == 0)
    last = F.col("last_purchase.value")
    target, ok = windows.hold_last(F.col("engaged"), last, F.col("valid_purchase"), last, -F.col("value"), F.col("value") < 60)
    return j.select("recording_id", "tick", "engaged", target.alias("target"), ok.alias("ok"))


@query("action_horizon", f"""WITH {FRAMES_SQL}, e AS (SELECT episode_index, max(frame_index) AS last FROM frames GROUP BY 1),
  h AS (SELECT f.episode_index, f.frame_index, f.frame_index + k > last AS is_pad, k AS step, least(f.frame_index + k, last) AS at
        FROM frames f JOIN e USING (episode_index), range(0, 16) t(k))
  SELECT h.episode_index, h.frame_index, step, is_pad, dim, round(f.action[dim + 1], 9) AS a
  FROM h JOIN frames f ON f.episode_index = h.episode_index AND f.frame_index = h.at, range(0, 32) t(dim)""")
def _(spark, sf):
    out = windows.action_horizon(frames(spark, sf), ["episode_index"], "frame_index", F.col("action"), horizon=16, size=1000)
    zipped = F.arrays_zip("chunk", "chunk_is_pad")
    steps = out.select("episode_index", "frame_index", F.posexplode(zipped).alias("step", "z"))
    return entries(steps.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), F.col("z.chunk_is_pad").alias("is_pad"), F.col("z.chunk").alias("v")))


def entries(df, value="v", name="a"):
    """One row per entry of a vector."""
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(value).alias("dim", name)).select(*rest, F.col("dim").cast("bigint").alias("dim"), F.round(name, 9).alias(name))


@query("delta_offsets", f"""WITH {FRAMES_SQL}, e AS (SELECT episode_index, max(frame_index) AS last FROM frames GROUP BY 1)
  SELECT f.episode_index, f.frame_index, b.vec_id AS baseline, f.frame_index - 100000 < 0 AS baseline_is_pad, f.vec_id AS current_,
    n.vec_id AS future, f.frame_index + 10 > last AS future_is_pad
  FROM frames f JOIN e USING (episode_index)
  JOIN frames b ON b.episode_index = f.episode_index AND b.frame_index = greatest(f.frame_index - 100000, 0)
  JOIN frames n ON n.episode_index = f.episode_index AND n.frame_index = least(f.frame_index + 10, last)""")
def _(spark, sf):
    out = windows.delta_offsets(
        frames(spark, sf), ["episode_index"], "frame_index", F.col("vec_id"), {"baseline": -100_000, "current_": 0, "future": 10})
    return out.select("episode_index", "frame_index", "baseline", "baseline_is_pad", "current_", "future", "future_is_pad")


@query("action_from_state_shift", f"""WITH {FRAMES_SQL}, e AS (SELECT episode_index, max(frame_index) AS last FROM frames GROUP BY 1)
  SELECT f.episode_index, f.frame_index, dim, round(n.state[dim + 1], 9) AS a FROM frames f JOIN e USING (episode_index)
  JOIN frames n ON n.episode_index = f.episode_index AND n.frame_index = least(f.frame_index + 2, last), range(0, 32) t(dim)""")
def _(spark, sf):
    out = windows.action_from_state_shift(
        frames(spark, sf).drop("action"), ["episode_index"], "frame_index", F.col("state"), 2, size=1000)
    return entries(out.select("episode_index", "frame_index", F.col("action").alias("v")))


def conversation_episodes(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("length")).withColumn("name", F.concat(F.lit("episode_"), F.col("conv_id").cast("string")))


EPISODES_SQL = """src AS (SELECT conv_id, count(*) AS length, 'episode_' || conv_id AS name FROM conversations GROUP BY 1),
episodes AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS episode_index,
  (sum(length) OVER (ORDER BY name) - length)::BIGINT AS from_index, (sum(length) OVER (ORDER BY name))::BIGINT AS to_index FROM src)"""


@query("renumber", f"""WITH {EPISODES_SQL}
  SELECT e.episode_index, c.turn AS frame_index, (c.turn::FLOAT / 30::FLOAT)::FLOAT AS timestamp, from_index + c.turn AS index
  FROM conversations c JOIN episodes e USING (conv_id)""")
def _(spark, sf):
    eps = windows.renumber(conversation_episodes(spark, sf), ["name"])
    f = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("frame_index"))
    return windows.renumber_frames(f, eps, ["conv_id"]).select("episode_index", "frame_index", "timestamp", "index")


@query("episode_offsets", """WITH l AS (SELECT conv_id AS episode_index, count(*) AS length FROM conversations GROUP BY 1)
  SELECT *, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS from_index,
    (sum(length) OVER (ORDER BY episode_index))::BIGINT AS to_index FROM l""")
def _(spark, sf):
    return windows.episode_offsets(conversation_episodes(spark, sf).select(F.col("conv_id").alias("episode_index"), "length"))


@query("row_to_episode", """WITH l AS (SELECT conv_id AS episode_index, count(*) AS length FROM conversations GROUP BY 1),
  e AS (SELECT *, sum(length) OVER (ORDER BY episode_index) - length AS f, sum(length) OVER (ORDER BY episode_index) AS t FROM l)
  SELECT event_id AS index, e.episode_index, (event_id - f)::BIGINT AS frame_index FROM events JOIN e ON event_id >= f AND event_id < t""")
def _(spark, sf):
    eps = windows.episode_offsets(conversation_episodes(spark, sf).select(F.col("conv_id").alias("episode_index"), "length"))
    r = table(spark, sf, "events").select(F.col("event_id").alias("index"))
    return rows.row_to_episode(r, eps)


@query("interval_diff", f"""WITH {STREAMS_SQL} SELECT recording_id, stream, sample_idx,
  t_ns - lag(t_ns) OVER (PARTITION BY recording_id, stream ORDER BY t_ns) AS dt FROM streams""")
def _(spark, sf):
    out = windows.interval_diff(streams(spark, sf), ["recording_id", "stream"], "t_ns", size=FIVE_DAYS_NS)
    return out.select("recording_id", "stream", "sample_idx", "dt")


@query("batch_center", """WITH x AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT vec_id, dim::BIGINT AS dim, round(v - avg(v) OVER (PARTITION BY label, dim), 9) AS centered FROM x""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = windows.batch_center(e, "label", "v")
    out = out.select("vec_id", F.posexplode("centered").alias("dim", "c"))
    return out.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("c", 9).alias("centered"))


@query("step_stats", f"""WITH {FRAMES_SQL}, p AS (SELECT episode_index, frame_index,
    [state[i] - lag(state[i]) OVER w for i in [1]] AS d1, state[1] - lag(state[1]) OVER w AS x, state[2] - lag(state[2]) OVER w AS y,
    state[3] - lag(state[3]) OVER w AS z FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
  q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM p WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
  r AS (SELECT episode_index, sqrt(x*x+y*y+z*z) AS step, sqrt(px*px+py*py+pz*pz) * sqrt(x*x+y*y+z*z) AS nn, px*x+py*y+pz*z AS uv FROM q)
  SELECT episode_index, count(step) AS n_steps, round(sum(step), 6) AS path_length, round(avg(step), 6) AS mean_step,
    count(*) FILTER (nn > 1e-6 AND uv / nn < 0) AS reversals, count(*) FILTER (nn > 1e-6) AS valid_pairs FROM r GROUP BY 1""".replace(
    "[state[i] - lag(state[i]) OVER w for i in [1]] AS d1, ", ""))
def _(spark, sf):
    xyz = [F.col("state")[i] for i in range(3)]
    out = windows.step_stats(frames(spark, sf), ["episode_index"], "frame_index", xyz, size=1000)
    return out.withColumns({"path_length": F.round("path_length", 6), "mean_step": F.round("mean_step", 6)})


TRIALS_SQL = """trials AS (SELECT user_id AS recording_id, CASE WHEN user_id % 4 = 0 THEN 'failure' ELSE 'success' END AS label,
  'task_' || (user_id % 12) AS task, min(epoch_us(ts)) * 1000 + 2 * 86400000000000 AS engaged_ns,
  max(epoch_us(ts)) * 1000 - 3 * 86400000000000 AS released_ns FROM events GROUP BY 1)"""


def trials(spark, sf):
    day = F.lit(DAY_NS)
    return streams(spark, sf).groupBy("recording_id").agg(
        (F.min("t_ns") + 2 * day).alias("engaged_ns"), (F.max("t_ns") - 3 * day).alias("released_ns")
    ).withColumns({
        "label": F.when(F.col("recording_id") % 4 == 0, "failure").otherwise("success"),
        "task": F.concat(F.lit("task_"), (F.col("recording_id") % 12).cast("string")),
    })


@query("trial_window_filter", f"""WITH {STREAMS_SQL}, {TRIALS_SQL} SELECT s.recording_id, sample_idx FROM streams s JOIN trials t
  ON s.recording_id = t.recording_id AND t_ns >= engaged_ns AND t_ns < released_ns WHERE label = 'success'""")
def _(spark, sf):
    return rows.trial_window_filter(streams(spark, sf), trials(spark, sf), ["recording_id"]).select("recording_id", "sample_idx")


CONTACTS_SQL = f"""contacts AS (SELECT recording_id, sample_idx AS contact_id, t_ns AS start_ns, t_ns + (value * 3600000)::BIGINT * 1000000 AS end_ns
  FROM streams WHERE stream = 'purchase')"""


def contacts(spark, sf):
    return streams(spark, sf).where("stream = 'purchase'").select(
        "recording_id", F.col("sample_idx").alias("contact_id"), F.col("t_ns").alias("start_ns"),
        (F.col("t_ns") + F.rint(F.col("value") * 3_600_000).cast("bigint") * 1_000_000).alias("end_ns"))


@query("interval_join", f"""WITH {STREAMS_SQL}, {CONTACTS_SQL} SELECT s.recording_id, sample_idx, contact_id FROM streams s JOIN contacts c
  ON s.recording_id = c.recording_id AND t_ns BETWEEN start_ns AND end_ns""")
def _(spark, sf):
    out = rows.interval_join(streams(spark, sf), contacts(spark, sf), ["recording_id"], size=DAY_NS)
    return out.select("recording_id", "sample_idx", "contact_id")


@query("frame_range_filter", f"""WITH {FRAMES_SQL}, r AS (SELECT label::BIGINT AS episode_index, (vec_id % 37) AS a, (vec_id % 37) + 4 AS b
    FROM embeddings WHERE vec_id % 25 = 0)
  SELECT episode_index, frame_index FROM frames f WHERE EXISTS (SELECT 1 FROM r WHERE r.episode_index = f.episode_index
    AND f.frame_index >= a AND f.frame_index < b)""")
def _(spark, sf):
    r = table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(
        F.col("label").cast("bigint").alias("episode_index"), (F.col("vec_id") % 37).alias("start"), (F.col("vec_id") % 37 + 4).alias("end"))
    return rows.frame_range_filter(frames(spark, sf), r, ["episode_index"], size=16).select("episode_index", "frame_index")


@query("finite_filter", """SELECT event_id, sqrt_ FROM (SELECT event_id, CASE WHEN value < 5 THEN 'nan'::DOUBLE WHEN value > 200 THEN 'inf'::DOUBLE
  ELSE value END AS sqrt_ FROM events) WHERE isfinite(sqrt_)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") < 5, float("nan")).when(
        F.col("value") > 200, float("inf")).otherwise(F.col("value")).alias("sqrt_"))
    return rows.finite_filter(e, ["sqrt_"])


@query("command_validate", f"""WITH {FRAMES_SQL} SELECT vec_id, list_bool_and(list_transform(action[1:6], lambda x: x * 5000 + 500 BETWEEN 0 AND 1000)) AS ok FROM frames""")
def _(spark, sf):
    f = frames(spark, sf)
    hand = F.transform(F.slice("action", 1, 6), lambda x: x * 5000 + 500)
    return f.select("vec_id", rows.command_validate(F.slice("state", 1, 6), hand).alias("ok"))


@query("mapped_index_check", f"""WITH {STREAMS_SQL}, {NEAR_SQL}, q AS (SELECT recording_id, tick, t_ns, CASE WHEN tick % 9 = 0 THEN -1 ELSE idx END AS src_idx
    FROM near WHERE stream = 'error')
  SELECT q.recording_id, tick, src_idx, s.t_ns IS NOT NULL AS in_range, q.t_ns - s.t_ns AS frame_gap,
    coalesce(abs(q.t_ns - s.t_ns) <= {TOL_NS}, false) AS within
  FROM q LEFT JOIN streams s ON s.recording_id = q.recording_id AND s.sample_idx = q.src_idx AND s.stream = 'error'""")
def _(spark, sf):
    ticks = near(spark, sf).select("recording_id", "tick", "t_ns", F.when(F.col("tick") % 9 == 0, -1).otherwise(
        F.col("near_error.sample_idx")).alias("src_idx"))
    cam = streams(spark, sf).where("stream = 'error'").withColumnRenamed("sample_idx", "frame_index")
    out = rows.mapped_index_check(ticks, cam, "recording_id", tol_ns=TOL_NS)
    return out.select("recording_id", "tick", "src_idx", "in_range", "frame_gap", "within")


def usable(spark, sf):
    s = streams(spark, sf)
    ticks = near(spark, sf).select(
        "recording_id", "tick", "t_ns", (F.col("tick") % 7 != 3).alias("clutch"), F.col("near_error.sample_idx").alias("src_idx_head"),
        (F.col("tick") % 11 != 0).alias("valid_head"))
    hand = s.where("stream = 'purchase'").select(
        "recording_id", "sample_idx", F.col("t_ns").alias("t_cmd_ns"),
        (F.col("t_ns") + (F.col("sample_idx") % 7) * F.lit(3_600_000_000_000)).alias("t_host_ns"))
    cam = s.where("stream = 'error'").withColumnRenamed("sample_idx", "frame_index")
    return rows.usable_rows(
        ticks, trials(spark, sf), s.where("stream = 'click'"), hand, s.where("stream = 'view'"), {"head": cam},
        cmd_age=TOL_NS, tactile_age=TOL_NS, camera_tol=TOL_NS, size=FIVE_DAYS_NS)


USABLE_SQL = f"""{STREAMS_SQL}, {NEAR_SQL}, {TRIALS_SQL},
  q AS (SELECT recording_id, tick, t_ns, tick % 7 <> 3 AS clutch, idx AS src, gap, tick % 11 <> 0 AS vh FROM near WHERE stream = 'error'),
  a AS (SELECT q.*, s.t_ns AS ta, s.sample_idx AS arm_idx FROM q ASOF LEFT JOIN (SELECT * FROM streams WHERE stream = 'click') s
        ON q.recording_id = s.recording_id AND q.t_ns >= s.t_ns),
  g AS (SELECT a.*, s.t_ns AS tg, s.sample_idx AS glove_idx FROM a ASOF LEFT JOIN (SELECT * FROM streams WHERE stream = 'view') s
        ON a.recording_id = s.recording_id AND a.t_ns >= s.t_ns),
  hc AS (SELECT recording_id, t_ns + (sample_idx % 7) * 3600000000000 AS t_ns, max({{'i': t_ns, 's': sample_idx}}) AS m
         FROM streams WHERE stream = 'purchase' GROUP BY 1, 2),
  h AS (SELECT g.*, s.t_ns AS th, s.m.i AS ti, s.m.s AS hand_idx FROM g ASOF LEFT JOIN hc s ON g.recording_id = s.recording_id AND g.t_ns >= s.t_ns),
  u AS (SELECT h.recording_id, tick, h.t_ns, coalesce(h.t_ns >= engaged_ns AND h.t_ns < released_ns, false) AS in_trial, clutch AS engaged,
          coalesce(h.t_ns - ta <= {TOL_NS}, false) AS arm_fresh,
          coalesce(h.t_ns - th <= {TOL_NS} AND h.t_ns - ti BETWEEN 0 AND {TOL_NS}, false) AS hand_fresh,
          coalesce(h.t_ns - tg <= {TOL_NS}, false) AS glove_fresh, vh AND gap <= {TOL_NS} AS camera_head, arm_idx, hand_idx, glove_idx
        FROM h LEFT JOIN (SELECT * FROM trials WHERE label = 'success') t USING (recording_id))"""


@query("usable_rows", f"""WITH {USABLE_SQL} SELECT recording_id, tick, in_trial, engaged, arm_fresh, hand_fresh, glove_fresh, camera_head,
  in_trial AND engaged AND arm_fresh AND hand_fresh AND glove_fresh AND camera_head AS usable, arm_idx, hand_idx, glove_idx FROM u""")
def _(spark, sf):
    return usable(spark, sf).select("recording_id", "tick", "in_trial", "engaged", "arm_fresh", "hand_fresh", "glove_fresh",
                                    "camera_head", "usable", "arm_idx", "hand_idx", "glove_idx")
