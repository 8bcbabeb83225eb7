"""Queries for glove signals, integrity, loss, noise and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.alignment import GATE_SQL, gate_result
from trajq.bindings.data import FIVE_DAYS_NS, STREAMS_SQL, TACTILE_SQL, streams, table, tactile
from trajq.bindings.statistics import rounded
from trajq.bindings.vectors import PARTS_SQL
from trajq.functions import responses
from trajq.operators import quality, sampling
from trajq.operators import tactile as tac
from trajq.plans.lineage import checkpoint

QUERIES, SQL = {}, {}
HAND = ["recording_id", "hand"]
ANSWER = ["conv_id", "turn"]
GATE_ROWS = f"gate_rows AS ({GATE_SQL})"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def padded(df):
    return df.withColumn("pad", F.col("pad").cast("bigint"))


@query("pad_series", f"""WITH {TACTILE_SQL} SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx,
  round(coalesce(sum(x) FILTER (abs(x) >= 0.03), 0), 6) AS value FROM cells GROUP BY ALL""")
def _(spark, sf):
    return rounded(padded(tac.pad_series(tactile(spark, sf)).drop("t_ns")), ["value"])


FINGERS_SQL = f"""{TACTILE_SQL}, {PARTS_SQL},
padf AS (SELECT recording_id, hand, pad, sample_idx, any_value(t_ns) - min(any_value(t_ns)) OVER (PARTITION BY recording_id, hand) AS t_ns, coalesce(sum(x) FILTER (x >= 0.03), 0) AS f, max(x) AS mx FROM cells GROUP BY 1, 2, 3, 4),
fing AS (SELECT recording_id, hand, part, sample_idx, any_value(t_ns) AS t_ns, max(f) AS force FROM padf JOIN parts USING (pad) GROUP BY 1, 2, 3, 4)"""


@query("finger_force", f"WITH {FINGERS_SQL} SELECT recording_id, hand, part, sample_idx, round(force, 6) AS force FROM fing")
def _(spark, sf):
    return rounded(tac.finger_force(tactile(spark, sf)).drop("t_ns"), ["force"])


@query("pad_peak", f"WITH {FINGERS_SQL} SELECT recording_id, hand, part, round(max(force), 6) AS peak FROM fing GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(tac.pad_peak(tac.finger_force(tactile(spark, sf))), ["peak"])


@query("total_force", f"WITH {TACTILE_SQL} SELECT recording_id, hand, sample_idx, round(sum(x), 6) AS total FROM cells GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(tac.total_force(tactile(spark, sf)).drop("t_ns"), ["total"])


@query("hard_fault", f"""WITH {TACTILE_SQL}, s AS (SELECT recording_id, hand, pad, sample_idx, coalesce(sum(x) FILTER (abs(x) >= 0.03), 0) AS v FROM cells GROUP BY ALL)
  SELECT recording_id, hand, sum((m > 0.03)::INT) = 0 AS hard_fault FROM (SELECT recording_id, hand, pad, max(v) AS m FROM s GROUP BY ALL) GROUP BY 1, 2""")
def _(spark, sf):
    return tac.hard_fault(tactile(spark, sf))


@query("pad_shear", f"""WITH {TACTILE_SQL} SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx, round(avg(x), 6) AS mean_x, round(avg(x * 0.5), 6) AS mean_y FROM cells GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    t = tactile(spark, sf).withColumnRenamed("force", "shear_x").withColumn("shear_y", F.transform("shear_x", lambda v: v * 0.5))
    return rounded(padded(tac.pad_shear(t)), ["mean_x", "mean_y"])


# Model answers written out of the conversation ids: fenced JSON, prose, object or text intervals, junk.
def model_responses(spark, sf):
    """One answer per (conv_id, turn)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    i = F.col("conv_id") + F.col("turn")
    s = (i % 13).cast("string")
    body = F.concat(
        F.lit('{"contacts": [{"start": '), (i % 17 / 10).cast("string"), F.lit(', "end": '), (i % 17 / 10 + 0.6).cast("string"),
        F.lit(', "confirmed": ['),
        F.when(i % 3 == 0, '"thumb"').when(i % 3 == 1, '"index", "middle", "pinky"').otherwise('"ring", "thumb"'),
        F.lit('], "object": "'), F.when(i % 5 == 0, "").otherwise("cup"), F.lit('", "uncertain_interval": '),
        F.when(i % 11 == 0, "true").otherwise("false"), F.lit('}, {"start": "x"}, 7], "free": [['), s, F.lit(", "), s, F.lit('.9], {"start": "0.5", "end": '),
        F.lit('2}, "junk", ["a", 1]]}'))
    raw = F.when(i % 19 == 7, F.lit("no answer")).when(i % 19 == 8, F.lit('{"free": [1,')).when(i % 19 == 9, F.lit("broken {not json}")).when(
        i % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done."))).otherwise(body)
    return c.select(*c.columns, (i % 10).alias("recording_id"), F.when(F.floor(i / 10) % 2 == 0, "left").otherwise("right").alias("hand"), raw.alias("raw"))


#: An answer, and what follows from it, belongs to its (conv_id, turn).
RESP_SQL = """resp AS (SELECT struct_pack(conv_id := conv_id, turn := turn) AS conv_id, conv_id + turn AS i, i % 10 AS recording_id, CASE WHEN i // 10 % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
  i % 19 NOT IN (7, 8, 9) AS ok, i % 19 = 9 AS bad FROM conversations),
contacts AS (SELECT conv_id, recording_id, hand, round((i % 17) / 10 * 1e9)::BIGINT AS start_ns, round(((i % 17) / 10 + 0.6) * 1e9)::BIGINT AS end_ns,
  CASE i % 3 WHEN 0 THEN ['thumb'] WHEN 1 THEN ['index', 'middle', 'pinky'] ELSE ['ring', 'thumb'] END AS confirmed,
  CASE WHEN i % 5 = 0 THEN '' ELSE 'cup' END AS object, i % 11 = 0 AS skip FROM resp WHERE ok),
free AS (SELECT conv_id, recording_id, hand, 0 AS free_id, (i % 13) * 1000000000 AS start_ns, (i % 13) * 1000000000 + 900000000 AS end_ns FROM resp WHERE ok
  UNION ALL SELECT conv_id, recording_id, hand, 1, 500000000, 2000000000 FROM resp WHERE ok)"""


# '{"free": [1,' holds no closing brace, so nothing is salvaged: an empty answer, not an error.
@query("parse_model_json", f"WITH {RESP_SQL} SELECT conv_id.conv_id AS conv_id, conv_id.turn AS turn, CASE WHEN ok THEN 1 WHEN bad THEN -1 ELSE 0 END::BIGINT AS state, CASE WHEN ok THEN 'cup or none' END AS has_contact FROM resp")
def _(spark, sf):
    j = model_responses(spark, sf).withColumn("json", responses.parse_model_json(F.col("raw")))
    state = F.when(F.col("json").isNull(), -1).when(F.col("json") == "{}", 0).otherwise(1)
    return j.select(*ANSWER, state.cast("bigint").alias("state"), F.when(F.get_json_object("json", "$.contacts").isNotNull(), "cup or none").alias("has_contact"))


def intervals(spark, sf):
    parsed = responses.normalize_responses(model_responses(spark, sf))
    return parsed, *responses.explode_intervals(parsed, [*ANSWER, *HAND])


@query("normalize_intervals", f"""WITH {RESP_SQL} SELECT conv_id.conv_id AS conv_id, conv_id.turn AS turn, 'free' AS kind, start_ns, end_ns FROM free
  UNION ALL SELECT conv_id.conv_id, conv_id.turn, 'contact', start_ns, end_ns FROM contacts""")
def _(spark, sf):
    _, c, f = intervals(spark, sf)
    cols = [*ANSWER, "kind", "start_ns", "end_ns"]
    return f.withColumn("kind", F.lit("free")).select(*cols).unionByName(c.withColumn("kind", F.lit("contact")).select(*cols))


def qc_inputs(spark, sf):
    """Contacts and free intervals numbered by conversation and turn, frames of every hand."""
    _, c, f = intervals(spark, sf)
    c = c.withColumn("contact_id", F.struct("conv_id", "turn")).drop("conv_id", "turn")
    f = f.withColumn("free_id", F.struct("conv_id", "turn", "free_id")).drop("conv_id", "turn")
    t = tactile(spark, sf).withColumn("force", F.when(F.col("pad") == 18, F.transform("force", lambda v: v * 0)).otherwise(
        F.transform("force", lambda v: F.when(F.abs(v) < 0.2, 0.0).otherwise(v))))
    # One row per frame instead of one per pad: small next to the taxels and read several times.
    return t, checkpoint(quality.hand_frames(t)), c, f


FRAME_SQL = f"""{TACTILE_SQL.replace('SELECT recording_id, hand, pad, sample_idx, t_ns, generate_subscripts(force, 1) - 1 AS cell, unnest(force) AS x FROM tactile',
  'SELECT recording_id, hand, pad, sample_idx, t_ns, cell, CASE WHEN pad = 18 OR abs(x0) < 0.2 THEN 0 ELSE x0 END AS x FROM (SELECT *, generate_subscripts(force, 1) - 1 AS cell, unnest(force) AS x0 FROM tactile)')},
{PARTS_SQL}, padf AS (SELECT recording_id, hand, pad, sample_idx, any_value(t_ns) - min(any_value(t_ns)) OVER (PARTITION BY recording_id, hand) AS t_ns, coalesce(sum(x) FILTER (x >= 0.03), 0) AS f, max(x) AS mx FROM cells GROUP BY 1, 2, 3, 4),
fing AS (SELECT recording_id, hand, part, sample_idx, any_value(t_ns) AS t_ns, max(f) AS force, max(mx) AS mx FROM padf JOIN parts USING (pad) GROUP BY 1, 2, 3, 4),
fr AS (SELECT recording_id, hand, sample_idx, any_value(t_ns) AS t_ns, sum(force) AS total, max(mx) >= 0.03 AS visible FROM fing GROUP BY 1, 2, 3),
{RESP_SQL},
ever AS (SELECT recording_id, hand, part, max(force) AS ev FROM fing GROUP BY 1, 2, 3),
cn AS (SELECT c.conv_id, count(*) AS n FROM contacts c JOIN fr USING (recording_id, hand) WHERE NOT skip AND t_ns BETWEEN start_ns AND end_ns GROUP BY 1 HAVING n >= 3),
cf AS (SELECT c.*, unnest(list_filter(confirmed, lambda f: f <> 'pinky')) AS finger, generate_subscripts(list_filter(confirmed, lambda f: f <> 'pinky'), 1) AS fpos,
   len(list_filter(confirmed, lambda f: f <> 'pinky')) AS nconf FROM contacts c WHERE conv_id IN (SELECT conv_id FROM cn)),
pk AS (SELECT conv_id, finger, any_value(fpos) AS fpos, any_value(nconf) AS nconf, max(force) AS peak FROM cf JOIN fing f ON f.recording_id = cf.recording_id AND f.hand = cf.hand AND f.part = finger
   AND t_ns BETWEEN start_ns AND end_ns GROUP BY 1, 2),
sl AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS nsil FROM pk WHERE peak = 0),
loss AS (SELECT c.recording_id, c.hand, s.conv_id AS contact_id, s.finger, s.fpos, s.nsil = s.nconf AND s.nconf >= 2 AS whole_hand, c.start_ns, c.end_ns, c.object, c.confirmed,
   CASE WHEN e.ev = 0 AND s.nsil = s.nconf AND s.nconf >= 2 THEN 'hard' WHEN e.ev = 0 THEN 'weak' ELSE 'suspect' END AS kind
   FROM sl s JOIN contacts c USING (conv_id) JOIN ever e ON e.recording_id = c.recording_id AND e.hand = c.hand AND e.part = s.finger)"""


@query("loss_check", f"WITH {FRAME_SQL} SELECT recording_id, hand, contact_id.conv_id AS conv_id, contact_id.turn AS turn, finger, whole_hand, kind FROM loss")
def _(spark, sf):
    _, fr, c, _ = qc_inputs(spark, sf)
    return quality.loss_check(fr, c).select("recording_id", "hand", "contact_id.*", "finger", "whole_hand", "kind")


NOISE_SQL = f"""{FRAME_SQL},
ff AS (SELECT struct_pack(conv_id := f.conv_id.conv_id, turn := f.conv_id.turn, free_id := f.free_id) AS free_id, fr.*, count(*) OVER (PARTITION BY f.conv_id, f.free_id) AS nfree FROM free f JOIN fr USING (recording_id, hand) WHERE t_ns BETWEEN start_ns AND end_ns),
v1 AS (SELECT *, CASE WHEN sample_idx - lag(sample_idx) OVER (PARTITION BY free_id ORDER BY sample_idx) <= 2 THEN 0 ELSE 1 END AS nw FROM ff WHERE nfree >= 3 AND visible),
v2 AS (SELECT *, sum(nw) OVER (PARTITION BY free_id ORDER BY sample_idx) AS g FROM v1),
cand AS (SELECT recording_id, hand, free_id, g, min(t_ns) AS s, max(t_ns) AS e, max(total) AS peak FROM v2 GROUP BY ALL HAVING max(t_ns) - min(t_ns) >= 300000000),
topn AS (SELECT *, row_number() OVER (PARTITION BY recording_id, hand ORDER BY (e - s) / 1e9 * greatest(peak, 1e-6) DESC, s, e, free_id) AS rank FROM cand)"""


@query("noise_candidates", f"""WITH {NOISE_SQL} SELECT recording_id, hand, free_id.conv_id AS conv_id, free_id.turn AS turn, free_id.free_id AS free_id, s / 1e9 AS start, e / 1e9 AS "end", (e - s) / 1e9 AS dur, round(peak, 6) AS peak FROM cand""")
def _(spark, sf):
    _, fr, _, f = qc_inputs(spark, sf)
    out = rounded(quality.noise_candidates(fr, f).drop("fingers"), ["peak"])
    return out.select("*", "free_id.*").drop(out["free_id"])


def top_candidates(spark, sf, fr, f):
    """Top candidates; distinct spans of time only, so that the order has no ties."""
    return sampling.top_noise(quality.noise_candidates(fr, f).withColumnRenamed("free_id", "z")).withColumnRenamed("z", "free_id")


@query("top_noise", f"""WITH {NOISE_SQL} SELECT recording_id, hand, rank::BIGINT AS rank, s / 1e9 AS start, e / 1e9 AS "end", round(peak, 6) AS peak FROM topn WHERE rank <= 5""")
def _(spark, sf):
    _, fr, _, f = qc_inputs(spark, sf)
    out = top_candidates(spark, sf, fr, f).withColumn("rank", F.col("rank").cast("bigint"))
    return rounded(out.select("recording_id", "hand", "rank", "start", "end", "peak"), ["peak"])


def verdicts(spark, sf):
    t, fr, c, f = qc_inputs(spark, sf)
    losses = quality.loss_check(fr, c)
    number = sum(F.col(f"free_id.{k}") for k in (*ANSWER, "free_id"))
    answers = (F.col("recording_id") + number) % 2 == 0  # the confirmation answers of the noise clips
    noise = quality.noise_candidates(fr, f).withColumn("confirmed", answers)
    hands = t.select(*HAND).distinct()
    return t, losses, quality.hand_verdict(hands, tac.hard_fault(t), c, losses, f, noise)


VERDICT_SQL = f"""{NOISE_SQL},
hf AS (SELECT recording_id, hand, sum((m > 0.03)::INT) = 0 AS fault FROM (SELECT recording_id, hand, pad, max(v) AS m FROM
   (SELECT recording_id, hand, pad, sample_idx, coalesce(sum(x) FILTER (abs(x) >= 0.03), 0) AS v FROM cells GROUP BY ALL) GROUP BY ALL) GROUP BY 1, 2),
lt AS (SELECT *, CASE WHEN object = '' THEN 'object' ELSE object END || ' at ' || printf('%.1f', start_ns / 1e9) || '-' || printf('%.1f', end_ns / 1e9) || 's' AS span,
   list_filter(list_filter(confirmed, lambda x: x <> 'pinky'), lambda x: x <> finger) AS others FROM loss),
lr AS (SELECT recording_id, hand, count(*) FILTER (kind = 'hard') AS nh, count(*) FILTER (kind = 'weak') AS nw,
   string_agg(finger || ' touches ' || span || ' and every visually confirmed finger in that grasp is silent', '; ' ORDER BY contact_id, fpos) FILTER (kind = 'hard') AS th,
   string_agg(finger || ' reported touching ' || span || ' but is silent, ' || CASE WHEN len(others) > 0 THEN 'while ' || array_to_string(others, ', ') || ' in the same grasp respond'
     ELSE 'and it is the only confirmed finger in that grasp (weak evidence)' END, '; ' ORDER BY contact_id, fpos) FILTER (kind = 'weak') AS tw FROM lt GROUP BY 1, 2),
fs AS (SELECT recording_id, hand, sum(greatest(end_ns - start_ns, 0)) / 1e9 AS free_s FROM free GROUP BY 1, 2),
ns AS (SELECT recording_id, hand, sum(e - s) / 1e9 AS noise_s, count(*) AS seg FROM cand WHERE (recording_id + free_id.conv_id + free_id.turn + free_id.free_id) % 2 = 0 GROUP BY 1, 2),
hv0 AS (SELECT h.recording_id, h.hand, fault AND EXISTS (SELECT 1 FROM contacts c WHERE c.recording_id = h.recording_id AND c.hand = h.hand) AS dead,
   coalesce(nh, 0) AS nh, coalesce(nw, 0) AS nw, th, tw, coalesce(free_s, 0) AS free_s, coalesce(noise_s, 0) AS noise_s, coalesce(seg, 0) AS seg
   FROM hf h LEFT JOIN lr USING (recording_id, hand) LEFT JOIN fs USING (recording_id, hand) LEFT JOIN ns USING (recording_id, hand)),
hv AS (SELECT recording_id, hand, CASE WHEN dead OR nh > 0 THEN 'REJECT' WHEN nw > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict,
   CASE WHEN dead THEN '[tier0] all 15 pads silent for the whole episode (vision confirms this hand grasps something)'
     WHEN nh > 0 THEN 'tactile loss (high confidence): ' || th WHEN nw > 0 THEN 'possible tactile loss (needs human check): ' || tw ELSE '' END AS reason,
   CASE WHEN dead THEN 0 ELSE seg END AS noise_seg, CASE WHEN dead THEN 0 ELSE free_s END AS free_s, CASE WHEN dead THEN 0 ELSE noise_s END AS noise_s,
   CASE WHEN NOT dead AND free_s > 1e-6 THEN noise_s / free_s ELSE 0 END AS noise_pct FROM hv0),
ev AS (SELECT recording_id, CASE max(CASE verdict WHEN 'REJECT' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'REJECT' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS verdict,
   sum(noise_seg)::BIGINT AS noise_seg, sum(noise_s) AS noise_s, sum(free_s) AS free_s FROM hv GROUP BY 1)"""


@query("hand_verdict", f"WITH {VERDICT_SQL} SELECT recording_id, hand, verdict, reason, noise_seg, round(free_s, 6) AS free_s, round(noise_s, 6) AS noise_s, round(noise_pct, 6) AS noise_pct FROM hv")
def _(spark, sf):
    return rounded(verdicts(spark, sf)[2], ["free_s", "noise_s", "noise_pct"])


def episode_results(spark, sf):
    return quality.episode_verdict(verdicts(spark, sf)[2])


@query("episode_verdict", f"""WITH {VERDICT_SQL} SELECT recording_id, verdict, noise_seg, round(noise_s, 6) AS noise_s, round(free_s, 6) AS free_s,
  round(100 * noise_s / greatest(free_s, 1e-6), 6) AS noise_pct FROM ev""")
def _(spark, sf):
    return rounded(episode_results(spark, sf).drop("error"), ["noise_s", "free_s", "noise_pct"])


@query("verdict_summary", f"""WITH {VERDICT_SQL}, x AS (SELECT recording_id, CASE WHEN recording_id = 9 THEN 'ERROR' ELSE verdict END AS verdict FROM ev)
  SELECT count(*) AS n, count(*) FILTER (verdict = 'REJECT') AS reject, count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'PASS') AS pass,
    count(*) FILTER (verdict = 'ERROR') AS error, 100.0::DOUBLE * count(*) FILTER (verdict IN ('REJECT', 'PASS')) / count(*) AS auto_pct,
    100.0::DOUBLE * count(*) FILTER (verdict = 'REVIEW') / count(*) AS review_pct FROM x""")
def _(spark, sf):
    hands = verdicts(spark, sf)[2]
    errors = hands.where("recording_id = 9").select("recording_id", F.lit("unreadable archive").alias("error")).distinct()
    return quality.verdict_summary(quality.episode_verdict(hands, errors))


@query("review_list", f"""WITH {VERDICT_SQL} SELECT e.verdict AS tier, h.recording_id, h.hand, h.verdict AS hand_verdict, finger, start_ns / 1e9 AS start, end_ns / 1e9 AS "end"
  FROM ev e JOIN hv h USING (recording_id) LEFT JOIN (SELECT * FROM loss WHERE kind IN ('hard', 'weak')) l ON l.recording_id = h.recording_id AND l.hand = h.hand
  WHERE e.verdict IN ('REJECT', 'REVIEW') AND h.verdict <> 'PASS'""")
def _(spark, sf):
    t, losses, hands = verdicts(spark, sf)
    out = quality.review_list(quality.episode_verdict(hands), hands, losses, tac.pad_peak(tac.finger_force(t)))
    return out.select("tier", "recording_id", "hand", "hand_verdict", "finger", "start", "end")


@query("noise_report", f"""WITH {VERDICT_SQL} SELECT recording_id, verdict, noise_seg, round(noise_s, 6) AS noise_s, round(100 * noise_s / greatest(free_s, 1e-6), 6) AS noise_pct
  FROM ev WHERE noise_seg > 0""")
def _(spark, sf):
    return rounded(quality.noise_report(episode_results(spark, sf)), ["noise_s", "noise_pct"])


_GAPS = """d AS (SELECT recording_id, stream, t_ns, t_ns - lag(t_ns) OVER (PARTITION BY recording_id, stream ORDER BY t_ns) AS dt FROM streams),
  m AS (SELECT recording_id, stream, quantile_cont(dt, 0.5) AS med, count(*) AS n_rows, min(t_ns) AS t0, max(t_ns) AS t1 FROM d GROUP BY 1, 2),
  b AS (SELECT recording_id, stream, count(*) FILTER (dt > med * f) AS n_big, max(dt) FILTER (dt > med * f) AS mx, min(t_ns - dt) FILTER (dt > med * f) AS at_
    FROM d JOIN m USING (recording_id, stream), (SELECT 2.5 AS f) GROUP BY 1, 2),
  g AS (SELECT recording_id, stream, count(*) FILTER (dt > med * 3) AS n_big, max(dt) FILTER (dt > med * 3) AS mx FROM d JOIN m USING (recording_id, stream) GROUP BY 1, 2),
  r AS (SELECT DISTINCT recording_id FROM streams),
  cam AS (SELECT recording_id, stream, o, CASE WHEN (recording_id + o) % 13 = 0 THEN NULL WHEN (recording_id + o) % 17 = 0 THEN -1 ELSE n_rows + (recording_id % 5) END AS nf, m.*, b.n_big, mx, at_
    FROM r CROSS JOIN (SELECT unnest(['click', 'view', 'purchase']) AS stream, unnest([1, 2, 3]) AS o) s LEFT JOIN m USING (recording_id, stream) LEFT JOIN b USING (recording_id, stream)),
  ct AS (SELECT recording_id, o, CASE WHEN n_rows IS NULL OR nf IS NULL THEN stream || ': missing file' ELSE concat_ws(' | ',
      CASE WHEN nf < 0 THEN stream || ': could not read the frame count (unreadable video?)' WHEN abs(nf - n_rows) > 2 THEN
        printf('%s: video has %d frames vs %d timestamp rows (diff %d)', stream, nf, n_rows, nf - n_rows) END,
      CASE WHEN n_big > 0 THEN stream || ': ' || n_big || ' abnormal frame interval(s), max ' || printf('%.0f', mx / 1e6) || 'ms (median ' || printf('%.0f', med / 1e6) || 'ms), first at t=' || printf('%.1f', (at_ - t0) / 1e9) || 's' END) END AS txt,
      CASE WHEN n_rows IS NOT NULL AND nf IS NOT NULL THEN (t1 - t0) / 1e9 END AS dur, stream FROM cam),
  sp AS (SELECT recording_id, 4 AS o, 'stream durations differ: ' || string_agg(stream || '=' || printf('%.1f', dur) || 's', ', ' ORDER BY o) FILTER (dur IS NOT NULL) AS txt
    FROM ct GROUP BY 1 HAVING count(dur) > 1 AND max(dur) - min(dur) > 1),
  gl AS (SELECT recording_id, o, CASE WHEN n_big IS NULL THEN hand || '_hand: missing file' WHEN n_big > 0 THEN hand || '_hand tactile: ' || n_big || ' gap(s), longest ' || printf('%.0f', mx / 1e6) || 'ms' END AS txt
    FROM r CROSS JOIN (SELECT unnest(['left', 'right']) AS hand, unnest(['error', 'signup']) AS stream, unnest([5, 6]) AS o) h LEFT JOIN g USING (recording_id, stream)),
  u AS (SELECT recording_id, o, txt FROM ct UNION ALL SELECT * FROM sp UNION ALL SELECT recording_id, o, txt FROM gl)"""


@query("integrity_check", f"WITH {STREAMS_SQL}, {_GAPS} SELECT recording_id, coalesce(string_agg(txt, ' | ' ORDER BY o) FILTER (txt <> ''), '') AS issues FROM u GROUP BY 1")
def _(spark, sf):
    s = streams(spark, sf)
    names = ["click", "view", "purchase"]
    counts = s.where(F.col("stream").isin(names)).groupBy("recording_id", "stream").agg(F.count("*").alias("n"))
    o = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("stream"))
    r = F.col("recording_id")
    counts = counts.select("recording_id", "stream", F.when((r + o) % 13 == 0, None).when((r + o) % 17 == 0, -1).otherwise(F.col("n") + r % 5).alias("n_frames"))
    gloves = s.where(F.col("stream").isin("error", "signup")).select("recording_id", F.when(F.col("stream") == "error", "left").otherwise("right").alias("hand"), "t_ns")
    out = quality.integrity_check(s.where(F.col("stream").isin(names)), counts, gloves, s.select("recording_id").distinct(), names, size=FIVE_DAYS_NS)
    return out.select("recording_id", F.array_join("issues", " | ").alias("issues"))


DUR_SQL = f"{STREAMS_SQL}, dur AS (SELECT recording_id, (max(t_ns) - min(t_ns)) / 1e9 / 86400 AS duration FROM streams WHERE stream = 'click' GROUP BY 1 HAVING count(*) >= 2)"


def durations(spark, sf):
    s = streams(spark, sf)
    meta = s.select("recording_id").distinct().withColumn("duration", F.lit(None).cast("double"))
    return quality.recording_durations(s, meta, stream="click").withColumn("duration", F.col("duration") / 86400)


@query("duration_stats", f"""WITH {DUR_SQL} SELECT count(*) AS n, round(min(duration), 6) AS min, round(avg(duration), 6) AS mean, round(max(duration), 6) AS max, round(sum(duration), 6) AS total,
  count(*) FILTER (duration > 25) AS n_over, round(avg((duration > 25)::INT), 6) AS share_over, round(quantile_cont(duration, 0.5), 6) AS median, round(quantile_cont(duration, 0.9), 6) AS p90 FROM dur""")
def _(spark, sf):
    return rounded(quality.duration_stats(durations(spark, sf), cap=25.0), ["min", "mean", "max", "total", "share_over", "median", "p90"])


@query("duration_histogram", f"WITH {DUR_SQL} SELECT floor(duration / 2) * 2 AS lo, count(*) AS n, floor(duration / 2) * 2 >= 25 AS over_cap FROM dur GROUP BY 1, 3")
def _(spark, sf):
    return quality.duration_histogram(durations(spark, sf), width=2.0, cap=25.0)


@query("prefix_clash", "SELECT substring(md5('d' || doc_id), 1, 3) AS prefix, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("name"))
    return quality.prefix_clash(d, length=3)


# The readable reasons of gate, integrity and verdicts in one list.
@query("reason_text", f"""WITH {GATE_ROWS}, gate_text AS (SELECT 'gate' AS source, recording_id, reason AS text FROM gate_rows WHERE reason <> 'ok') SELECT * FROM gate_text""".replace(
    "SELECT * FROM gate_text", f"""SELECT * FROM gate_text UNION ALL SELECT 'hand', recording_id, text FROM (WITH {VERDICT_SQL} SELECT recording_id, hand || ': ' || reason AS text FROM hv WHERE reason <> '')"""))
def _(spark, sf):
    g = gate_result(spark, sf).where("reason <> 'ok'").select(F.lit("gate").alias("source"), "recording_id", F.col("reason").alias("text"))
    h = verdicts(spark, sf)[2].where("reason <> ''").select(F.lit("hand").alias("source"), "recording_id", F.concat_ws(": ", "hand", "reason").alias("text"))
    return g.unionByName(h)


#: Names that these queries also had.
for name in ("parse_model_json", "normalize_intervals", "loss_check", "noise_candidates", "top_noise", "hand_verdict", "episode_verdict", "verdict_summary", "review_list", "noise_report", "reason_text"):
    query(f"{name}_turns", SQL[name])(QUERIES[name])
