"""Queries for statistics, sampling and glove normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.data import FRAMES_SQL, STREAMS_SQL, TACTILE_SQL, frames, streams, table, tactile
from trajq.operators import endless, padfit, sampling, stats
from trajq.plans.lineage import checkpoint

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


FLAT_SQL = f"{FRAMES_SQL}, flat AS (SELECT generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS x FROM frames)"


def flat(spark, sf):
    return stats.flat_dims(frames(spark, sf), [], "state").withColumn("dim", F.col("dim").cast("bigint"))


@query("vector_moments", f"""WITH {FLAT_SQL} SELECT dim, count(*) AS count, round(avg(x), 6) AS mean, round(avg(x * x), 6) AS mean_sq,
  round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std FROM flat GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.vector_moments(flat(spark, sf)), ["mean", "mean_sq", "min", "max", "std"])


HIST_SQL = """r AS (SELECT dim, min(x) AS lo, max(x) AS hi, count(*) AS n FROM flat GROUP BY 1),
b AS (SELECT dim, lo, hi, n, CASE WHEN (hi - lo) / 5000 > 0 THEN least(floor((x - lo) / ((hi - lo) / 5000)), 4999) ELSE 0 END AS bin FROM flat JOIN r USING (dim)),
c AS (SELECT dim, lo, hi, n, bin, count(*) AS c FROM b GROUP BY ALL), d AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS cum FROM c),
hist AS (SELECT dim, min(lo + bin * ((hi - lo) / 5000)) FILTER (cum >= 0.01::DOUBLE * n) AS q01, min(lo + bin * ((hi - lo) / 5000)) FILTER (cum >= 0.99::DOUBLE * n) AS q99 FROM d GROUP BY 1)"""


@query("histogram_quantiles", f"WITH {FLAT_SQL}, {HIST_SQL} SELECT dim, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM hist")
def _(spark, sf):
    return rounded(stats.histogram_quantiles(flat(spark, sf)), ["q01", "q99"])


@query("exact_quantiles", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1""")
def _(spark, sf):
    q = stats.quantile_table(table(spark, sf, "events"), ["event_type"], F.col("value"), {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return rounded(q, ["q01", "q50", "q99"])


@query("identity_constant_dims", f"""WITH {FRAMES_SQL}, flat AS (SELECT generate_subscripts(state, 1) - 1 AS dim,
    unnest(list_transform(state, lambda v, i: CASE WHEN i % 4 = 0 THEN 0.25::DOUBLE ELSE v END)) AS x FROM frames), {HIST_SQL},
  m AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM flat GROUP BY 1),
  k AS (SELECT *, q99 - q01 <= 1e-8 AND std <= 1e-8 AS constant FROM m JOIN hist USING (dim))
  SELECT dim, constant, round(CASE WHEN constant THEN 0 ELSE mean END, 6) AS mean, round(CASE WHEN constant THEN 1 ELSE std END, 6) AS std,
    round(CASE WHEN constant THEN -1 ELSE q01 END, 6) AS q01, round(CASE WHEN constant THEN 1 ELSE q99 END, 6) AS q99 FROM k""")
def _(spark, sf):
    f = frames(spark, sf).withColumn("state", F.transform("state", lambda v, i: F.when((i + 1) % 4 == 0, 0.25).otherwise(v)))
    d = stats.flat_dims(f, [], "state").withColumn("dim", F.col("dim").cast("bigint"))
    out = stats.norm_stats(d).select("dim", "constant", "mean", "std", "q01", "q99")
    return rounded(out, ["mean", "std", "q01", "q99"])


# Two datasets (even / odd episodes) with different delta rules.
MULTI_SQL = """kept AS (SELECT *, episode_index % 2 AS ds FROM frames),
  last AS (SELECT episode_index, max(frame_index) AS last FROM kept GROUP BY 1),
  hz AS (SELECT k.ds, k.state, n.action FROM (SELECT *, unnest(range(0, 8)) AS s FROM kept JOIN last USING (episode_index)) k
         JOIN kept n ON n.episode_index = k.episode_index AND n.frame_index = least(k.frame_index + s, last)),
  flat0 AS (SELECT 'state' AS key, generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS x FROM kept UNION ALL
    SELECT 'actions', generate_subscripts(action, 1) - 1, unnest(list_transform(action, lambda v, i: CASE WHEN i <= CASE WHEN ds = 0 THEN 9 ELSE 3 END THEN v - state[i] ELSE v END)) FROM hz),
  flat AS (SELECT {'key': key, 'd': dim} AS dim, x FROM flat0)"""


@query("norm_stats_multi", f"""WITH {FRAMES_SQL}, {MULTI_SQL}, {HIST_SQL}, m AS (SELECT dim, count(*) AS count, avg(x) AS mean, stddev_pop(x) AS std FROM flat GROUP BY 1)
  SELECT dim.key AS key, dim.d AS dim, count, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM m JOIN hist USING (dim)""")
def _(spark, sf):
    f = frames(spark, sf)
    sets = [(f.where("episode_index % 2 = 0"), [True] * 9 + [False]), (f.where("episode_index % 2 = 1"), [True] * 3)]
    out = stats.norm_stats_multi(sets, horizon=8)
    out = out.select("key", F.col("dim").cast("bigint").alias("dim"), "count", "mean", "std", "q01", "q99")
    return rounded(out, ["mean", "std", "q01", "q99"])


@query("row_cap", """WITH l AS (SELECT conv_id AS episode_index, count(*) AS length FROM conversations GROUP BY 1),
  c AS (SELECT *, least(length, 200 - (sum(length) OVER (ORDER BY episode_index) - length))::BIGINT AS take FROM l) SELECT * FROM c WHERE take > 0""")
def _(spark, sf):
    e = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.count("*").alias("length"))
    return stats.row_cap(e, 200)


@query("column_stats", f"""WITH {FRAMES_SQL}, u AS (SELECT episode_index, 'state' AS c, generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS x FROM frames
  UNION ALL SELECT episode_index, 'frame_index', 0, frame_index::DOUBLE FROM frames)
  SELECT episode_index, c AS "column", dim, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
    count(*) AS count, grouping(episode_index)::BIGINT AS is_total FROM u GROUP BY GROUPING SETS ((c, dim, episode_index), (c, dim))""")
def _(spark, sf):
    out = stats.column_stats(frames(spark, sf), ["state", "frame_index"])
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), ["min", "max", "mean", "std"])


@query("merged_moments", f"""WITH {FRAMES_SQL}, u AS (SELECT episode_index, 'state' AS c, generate_subscripts(state, 1) - 1 AS dim, unnest(state) AS x FROM frames
  UNION ALL SELECT episode_index, 'action', generate_subscripts(action, 1) - 1, unnest(action) FROM frames)
  SELECT (episode_index % 3)::BIGINT AS part, c AS "column", dim::BIGINT AS dim, count(*) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM u GROUP BY GROUPING SETS ((episode_index % 3, c, dim), (c, dim))""")
def _(spark, sf):
    """Old and new batches of episodes, merged to three parts, and these to the whole."""
    f = frames(spark, sf).withColumn("part", F.col("episode_index") % 3)
    keys, columns = ["part", "episode_index"], ["state", "action"]
    old, new = (stats.moment_rows(stats.column_entries(f.where(w), columns, keys), keys) for w in ("vec_id % 4 = 0", "vec_id % 4 <> 0"))
    parts = checkpoint(stats.merge_moments(old.unionByName(new), ["part"]))
    whole = stats.merge_moments(parts).withColumn("part", F.lit(None).cast("bigint"))
    out = stats.moment_stats(parts.unionByName(whole)).select("part", "column", F.col("dim").cast("bigint").alias("dim"), "count", "min", "max", "mean", "std")
    return rounded(out, ["min", "max", "mean", "std"])


@query("delta_stats_check", f"""WITH {FRAMES_SQL}, m AS (SELECT dim, avg(x) AS mean FROM (SELECT generate_subscripts(action, 1) - 1 AS dim, unnest(action) AS x FROM frames) GROUP BY 1),
  v AS (SELECT list(mean ORDER BY dim) AS v FROM m)
  SELECT greatest(abs(v[11]), abs(v[12]), abs(v[13])) < 50 AS xyz_small, abs(v[14] - 1) < 0.3 AND abs(v[18] - 1) < 0.3 AS rot_near_identity FROM v""")
def _(spark, sf):
    return stats.delta_stats_check(stats.vector_moments(stats.flat_dims(frames(spark, sf), [], "action")))


CELLS_SQL = f"""{TACTILE_SQL},
rk AS (SELECT recording_id, hand, sample_idx, row_number() OVER (PARTITION BY recording_id, hand ORDER BY md5('42|' || recording_id || '|' || hand || '|' || sample_idx), sample_idx) AS r
       FROM (SELECT DISTINCT recording_id, hand, sample_idx FROM tactile)),
pool AS (SELECT c.* FROM cells c JOIN rk USING (recording_id, hand, sample_idx) WHERE r <= 4)"""


@query("seeded_sample", f"WITH {CELLS_SQL} SELECT DISTINCT recording_id, hand, pad::BIGINT AS pad, sample_idx FROM pool")
def _(spark, sf):
    out = sampling.seeded_sample(tactile(spark, sf), ["recording_id", "hand"], ["sample_idx"], 4)
    return out.select("recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx")


ALL_SQL = f"{TACTILE_SQL}, pool AS (SELECT * FROM cells)"
FIT_SQL = f"""{ALL_SQL},
q AS (SELECT hand, pad, count(*) AS n, quantile_cont(x, 0.05) AS base, quantile_cont(x, 0.999) AS high, quantile_cont(x, 0.5) AS med FROM pool GROUP BY 1, 2),
ma AS (SELECT hand, pad, quantile_cont(abs(x - med), 0.5) AS mad FROM pool JOIN q USING (hand, pad) GROUP BY 1, 2),
f AS (SELECT *, greatest(high - base, 1e-6) AS raw FROM q JOIN ma USING (hand, pad)),
fl AS (SELECT greatest(coalesce(quantile_cont(raw, 0.5) FILTER (raw > 1e-5) * 0.05, 1e-3), 1e-5) AS floor FROM f),
fit AS (SELECT hand, pad, n, base, greatest(raw, floor) AS scale,
  greatest((greatest(med + 4 * mad, base + 0.1 * raw) - base) / greatest(raw, floor), 0.1) AS threshold FROM f, fl)"""


@query("pad_norm_fit", f"""WITH {FIT_SQL} SELECT hand, pad::BIGINT AS pad, n, round(base, 6) AS base, round(scale, 6) AS scale, round(threshold, 6) AS threshold FROM fit""")
def _(spark, sf):
    out = padfit.pad_norm_fit(tactile(spark, sf)).withColumn("pad", F.col("pad").cast("bigint"))
    return rounded(out, ["base", "scale", "threshold"])


@query("dead_sensor_exclude", f"""WITH {TACTILE_SQL}, p AS (SELECT recording_id, hand, pad, stddev_pop(x) AS s FROM cells GROUP BY ALL)
  SELECT recording_id, hand, round(max(s), 6) AS max_std, max(s) < 0.122 AS dead FROM p GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(padfit.dead_sensor_exclude(tactile(spark, sf), limit=0.122), ["max_std"])


@query("robust_limits", f"""WITH {TACTILE_SQL}, s AS (SELECT recording_id, hand, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM cells GROUP BY 1, 2),
  h AS (SELECT recording_id, hand, quantile_cont(abs(x), 0.99) AS m FROM
     (SELECT recording_id, hand, x FROM cells UNION ALL SELECT recording_id, hand, x * 0.5 FROM cells) GROUP BY 1, 2)
  SELECT recording_id, hand, round(lo, 6) AS lo, round(hi, 6) AS hi, round(m, 6) AS shear_mag FROM s JOIN h USING (recording_id, hand)""")
def _(spark, sf):
    t = tactile(spark, sf)
    shear = t.select("recording_id", "hand", "pad", "sample_idx", F.col("force").alias("shear_x"), F.transform("force", lambda v: v * 0.5).alias("shear_y"))
    return rounded(padfit.robust_limits(t, shear=shear), ["lo", "hi", "shear_mag"])


TASKS_SQL = """tasks AS (SELECT DISTINCT label::BIGINT AS recording_id, CASE WHEN label < 4 THEN 'light' WHEN label < 8 THEN 'hard' WHEN label = 8 THEN 'rare' END AS task FROM embeddings)"""


def tasks(spark, sf):
    r = F.col("recording_id")
    return table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("recording_id")).distinct().withColumn(
        "task", F.when(r < 4, "light").when(r < 8, "hard").when(r == 8, "rare"))


SCALE_SQL = f"""{ALL_SQL}, {TASKS_SQL}, sb AS (SELECT hand, pad, quantile_cont(x, 0.05) AS base FROM pool GROUP BY 1, 2),
dev AS (SELECT recording_id, task, x - base AS d FROM pool JOIN sb USING (hand, pad) JOIN tasks USING (recording_id)),
scales AS (SELECT task, greatest(quantile_cont(d, 0.999), 1e-6) AS scale, count(DISTINCT recording_id) AS n_episodes FROM dev WHERE task IS NOT NULL GROUP BY 1 HAVING n_episodes >= 3
  UNION ALL SELECT NULL, greatest(quantile_cont(d, 0.999), 1e-6), NULL FROM dev)"""


@query("task_scale_fit", f"WITH {SCALE_SQL} SELECT task, round(scale, 6) AS scale, n_episodes FROM scales")
def _(spark, sf):
    return rounded(padfit.task_scale_fit(tactile(spark, sf), tasks(spark, sf)), ["scale"])


@query("task_scale_coverage", f"WITH {SCALE_SQL} SELECT count(s.task) AS matched, count(*) AS total, count(s.task) / count(*) AS match_rate FROM tasks t LEFT JOIN scales s ON s.task = t.task")
def _(spark, sf):
    t = tasks(spark, sf)
    return padfit.task_scale_coverage(t, padfit.task_scale_fit(tactile(spark, sf), t))


@query("broadcast_lookup", f"""WITH {SCALE_SQL} SELECT t.recording_id, t.hand, t.pad::BIGINT AS pad, t.sample_idx, round(sb.base, 6) AS base,
  round(coalesce(s.scale, (SELECT scale FROM scales WHERE task IS NULL)), 6) AS scale
  FROM tactile t JOIN tasks k USING (recording_id) LEFT JOIN scales s ON s.task = k.task JOIN sb ON sb.hand = t.hand AND sb.pad = t.pad""")
def _(spark, sf):
    t, k = tactile(spark, sf), tasks(spark, sf)
    base = padfit.exact_quantiles(padfit.finite_cells(t, ["hand", "pad"]), ["hand", "pad"], F.col("x"), {"base": 0.05})
    out = padfit.broadcast_lookup(t, k, padfit.task_scale_fit(t, k), base)
    out = out.select("recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx", "base", "scale")
    return rounded(out, ["base", "scale"])


@query("tactile_activity", f"""WITH {FIT_SQL}, v AS (SELECT recording_id, hand, pad, cell, var_pop(x) AS v FROM cells GROUP BY ALL),
  p AS (SELECT recording_id, hand, pad, avg(v) AS v FROM v GROUP BY ALL), va AS (SELECT recording_id, hand, avg(v) AS variance FROM p GROUP BY ALL),
  h AS (SELECT recording_id, hand, sample_idx, max(((list_max(force) - base) / scale > threshold)::INT) AS hit FROM tactile JOIN fit USING (hand, pad) GROUP BY ALL),
  r AS (SELECT recording_id, hand, avg(hit) AS contact_rate, count(*) AS n_frames FROM h GROUP BY ALL)
  SELECT recording_id, hand, round(variance, 6) AS variance, round(contact_rate, 6) AS contact_rate, n_frames FROM va JOIN r USING (recording_id, hand)""")
def _(spark, sf):
    t = tactile(spark, sf)
    return rounded(padfit.tactile_activity(t, padfit.pad_norm_fit(t)), ["variance", "contact_rate"])


@query("top_longest", f"""WITH {STREAMS_SQL}, d AS (SELECT recording_id, (max(t_ns) - min(t_ns)) / 1e9 AS duration FROM streams GROUP BY 1)
  SELECT recording_id, round(duration, 6) AS duration FROM d WHERE duration > 2400000 ORDER BY d.duration DESC, recording_id LIMIT 20""")
def _(spark, sf):
    d = streams(spark, sf).groupBy("recording_id").agg(((F.max("t_ns") - F.min("t_ns")) / 1e9).alias("duration"))
    return rounded(sampling.top_longest(d, cap=2_400_000.0), ["duration"])


@query("first_n_accepted", """WITH e AS (SELECT 'doc_' || doc_id AS name, quality = 1 AND toxic = 0 AS accepted FROM labels),
  f AS (SELECT name FROM e WHERE accepted ORDER BY name LIMIT 50) SELECT name, accepted, name IN (SELECT name FROM f) AS chosen FROM e""")
def _(spark, sf):
    e = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "quality", "toxic")
    return sampling.first_n_accepted(e, (F.col("quality") == 1) & (F.col("toxic") == 0), 50).select("name", "accepted", "chosen")


@query("max_energy_clip", f"""WITH {FRAMES_SQL}, e AS (SELECT episode_index, frame_index, list_sum(list_transform(action, lambda v: abs(v))) / 32 AS e FROM frames),
  p AS (SELECT episode_index, frame_index AS pk FROM e ORDER BY e DESC, episode_index, frame_index LIMIT 1),
  s AS (SELECT episode_index, greatest(0, least(pk - 6, (SELECT max(frame_index) + 1 FROM e x WHERE x.episode_index = p.episode_index) - 12)) AS s FROM p)
  SELECT e.episode_index, frame_index FROM e JOIN s ON e.episode_index = s.episode_index AND frame_index >= s AND frame_index < s + 12""")
def _(spark, sf):
    energy = F.aggregate("action", F.lit(0.0), lambda s, v: s + F.abs(v)) / 32
    out = sampling.max_energy_clip(frames(spark, sf), energy, order="frame_index", length=12, lead=6)
    return out.select("episode_index", "frame_index")


@query("weighted_mix", """WITH u AS (SELECT 'documents' AS dataset, doc_id AS id, 0.25::DOUBLE AS w FROM documents UNION ALL SELECT 'conversations', conv_id * 100 + turn, 0.75 FROM conversations),
  s AS (SELECT dataset, count(*) AS n, max(w) AS w FROM u GROUP BY 1), k AS (SELECT dataset, w * min(n / w) OVER () / n AS keep FROM s)
  SELECT dataset, id FROM u JOIN k USING (dataset) WHERE ('0x' || substr(md5('42|' || dataset || '|' || id), 1, 8))::BIGINT / 4294967296.0 < keep""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return sampling.weighted_mix({"documents": (docs, 0.25), "conversations": (conv, 0.75)}, ["id"])


# The rounds of a swap-or-not permutation of 0..n-1, as text draws.
def _draw_sql(seed, *parts):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"


_MIRROR = f"((({_draw_sql(42, 'dataset', 'epoch', 'r')} % n - x) % n + n) % n)"
ENDLESS_SQL = f"""u AS (SELECT 'documents' AS dataset, doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents
    UNION ALL SELECT 'conversations', conv_id * 100 + turn, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 FROM conversations),
  s AS (SELECT dataset, count(*) AS n FROM u GROUP BY 1), p AS (SELECT unnest(range(0, 2 * (SELECT count(*)::BIGINT FROM u))) AS position),
  w AS (SELECT position, CASE WHEN position // 4 < (position + 1) // 4 THEN 'documents' ELSE 'conversations' END AS dataset, CASE WHEN position // 4 < (position + 1) // 4 THEN position // 4 ELSE position - position // 4 END AS nth FROM p),
  e AS (SELECT position, dataset, nth // n AS epoch, n, nth % n AS i FROM w JOIN s USING (dataset)),
  m AS (SELECT *, list_reduce(list_prepend(i, range(0, 8)), lambda x, r: CASE WHEN {_draw_sql(42, 'dataset', 'epoch', 'r', f'greatest(x, {_MIRROR})')} & 1 = 1 THEN {_MIRROR} ELSE x END) AS place FROM e)
  SELECT position, dataset, epoch, u.id FROM m JOIN u USING (dataset, place)"""


@query("endless_mix", f"WITH {ENDLESS_SQL}")
def _(spark, sf):
    """Twice as many positions as there are rows: a quarter documents, the rest conversations, each repeated as its weight asks."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    stop = 2 * (docs.count() + conv.count())
    return endless.endless_mix({"documents": (docs, 0.25), "conversations": (conv, 0.75)}, ["id"], 0, stop, rounds=8, portable=True)


@query("sample_with_replacement", f"""WITH {TACTILE_SQL}, f AS (SELECT DISTINCT recording_id, hand, sample_idx FROM tactile),
  g AS (SELECT *, row_number() OVER (PARTITION BY recording_id, hand ORDER BY sample_idx) - 1 AS i, count(*) OVER (PARTITION BY recording_id, hand) AS n FROM f),
  d AS (SELECT recording_id, hand, t AS draw, {_draw_sql(42, 'recording_id', 'hand', 't')} % n AS i FROM (SELECT DISTINCT recording_id, hand, n FROM g), range(0, 20) r(t))
  SELECT recording_id, hand, pad::BIGINT AS pad, sample_idx, draw FROM d JOIN g USING (recording_id, hand, i) JOIN tactile USING (recording_id, hand, sample_idx)""")
def _(spark, sf):
    out = endless.sample_with_replacement(tactile(spark, sf), ["recording_id", "hand"], ["sample_idx"], 20, portable=True)
    return out.select("recording_id", "hand", F.col("pad").cast("bigint").alias("pad"), "sample_idx", F.col("draw").cast("bigint").alias("draw"))
