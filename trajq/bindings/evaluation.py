"""Queries for prediction errors, contrastive error, latents and resampling tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajq.bindings.data import FRAMES_SQL, frames, table
from trajq.bindings.statistics import rounded
from trajq.operators import evaluate as ev
from trajq.operators import resample as rs
from trajq.operators.dataset import roll_partner

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def predictions(spark, sf):
    return frames(spark, sf).select(
        "episode_index", "frame_index", "vec_id", (F.col("frame_index") % 8).alias("step"), F.col("action").alias("pred"), F.col("state").alias("target"), "state")


ERR_SQL = f"""{FRAMES_SQL}, d AS (SELECT episode_index, frame_index, vec_id, frame_index % 8 AS step, list_transform(list_zip(action, state), lambda p: p[1] - p[2]) AS d, state FROM frames),
err AS (SELECT *, sqrt(d[11] * d[11] + d[12] * d[12] + d[13] * d[13]) AS xyz_l2, list_sum(list_transform(d[14:19], lambda v: abs(v))) / 6 AS rot6d_mae,
  list_sum(list_transform(d[21:26], lambda v: abs(v))) / 6 AS hand_mae, list_sum(list_transform(d, lambda v: abs(v))) / 32 AS error, list_sum(list_transform(state, lambda v: abs(v))) / 32 AS zero FROM d)"""


@query("chunk_errors", f"WITH {ERR_SQL} SELECT vec_id, round(xyz_l2, 6) AS xyz_l2, round(rot6d_mae, 6) AS rot6d_mae, round(hand_mae, 6) AS hand_mae FROM err")
def _(spark, sf):
    out = ev.chunk_errors(predictions(spark, sf)).select("vec_id", "xyz_l2", "rot6d_mae", "hand_mae")
    return rounded(out, ["xyz_l2", "rot6d_mae", "hand_mae"])


@query("chunk_errors_zero", f"""WITH {FRAMES_SQL} SELECT vec_id, round(sqrt(state[11] * state[11] + state[12] * state[12] + state[13] * state[13]), 6) AS xyz_l2,
  round(list_sum(list_transform(state[21:26], lambda v: abs(0.25 - v))) / 6, 6) AS hand_mae FROM frames""")
def _(spark, sf):
    p = ev.baseline_rows(predictions(spark, sf), "zero", mean=F.array_repeat(F.lit(0.25), 32))
    return rounded(ev.chunk_errors(p).select("vec_id", "xyz_l2", "hand_mae"), ["xyz_l2", "hand_mae"])


@query("macro_micro", f"""WITH {ERR_SQL}, m AS (SELECT step, episode_index, avg(xyz_l2) AS m, sum(xyz_l2) AS s, count(*) AS n FROM err GROUP BY 1, 2)
  SELECT step, round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, count(*) AS n_episodes, sum(n)::BIGINT AS n_rows, round(stddev_samp(m) / sqrt(count(*)), 6) AS episode_se FROM m GROUP BY 1""")
def _(spark, sf):
    out = ev.macro_micro(ev.chunk_errors(predictions(spark, sf)), F.col("xyz_l2"), groups=["step"])
    return rounded(out, ["micro", "macro", "episode_se"])


@query("prediction_summary", f"""WITH {ERR_SQL}, s AS (SELECT *, zero > 0.1 AS active FROM err), e AS (SELECT avg(error) AS m FROM s GROUP BY episode_index)
  SELECT count(*) AS samples, round(avg(error), 6) AS mae, round(avg(zero), 6) AS zero_mae, count(*) FILTER (active) AS active_samples, round(avg(error) FILTER (active), 6) AS active_mae,
    round(avg(zero) FILTER (active), 6) AS active_zero_mae, round((SELECT avg(m) FROM e), 6) AS macro_episode_mae FROM s""")
def _(spark, sf):
    s = ev.row_errors(predictions(spark, sf)).withColumn("active", F.col("zero") > 0.1)
    return rounded(ev.prediction_summary(s), ["mae", "zero_mae", "active_mae", "active_zero_mae", "macro_episode_mae"])


POOL_SQL = f"""{FRAMES_SQL}, v AS (SELECT vec_id AS id, state AS z, action AS s FROM frames WHERE vec_id % 5 <> 0),
pair AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.z, b.s) / 0.5 AS l FROM v a, v b)"""


def pool(spark, sf):
    return frames(spark, sf).select(F.col("vec_id").alias("id"), F.col("state").alias("z"), F.col("action").alias("z_star"))


@query("contrastive_error", f"""WITH {POOL_SQL}, r AS (SELECT id, ln(sum(exp(l))) AS lr, max(l) FILTER (id = other) AS own FROM pair GROUP BY 1), c AS (SELECT other AS id, ln(sum(exp(l))) AS lc FROM pair GROUP BY 1)
  SELECT id, round(0.5 * ((lr - own) + (lc - own)), 6) AS error FROM r JOIN c USING (id)""")
def _(spark, sf):
    return rounded(ev.contrastive_error(pool(spark, sf), valid=F.col("id") % 5 != 0, temperature=0.5), ["error"])


def latents(spark, sf):
    f = frames(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 32).alias("batch"), F.col("state").alias("z"), "action")
    f = roll_partner(f, "batch", "vec_id", F.col("z"), F.col("vec_id") % 5 != 0)
    mix = F.zip_with("z", "action", lambda a, b: a * 0.9 + b * 0.1)
    return f.select("vec_id", "batch", "z", F.col("partner").alias("z_shuffle"), mix.alias("z_swap"), F.col("pair_valid").alias("valid_shuffle"),
                    (F.col("vec_id") % 5 != 0).alias("valid_swap"))


LAT_SQL = f"""{FRAMES_SQL}, b AS (SELECT vec_id, vec_id // 32 AS batch, state, action, vec_id % 5 <> 0 AS ok FROM frames),
p AS (SELECT *, coalesce(lead(state) OVER w, first(state) OVER w) AS sh, ok AND coalesce(lead(ok) OVER w, first(ok) OVER w) AS oks FROM b WINDOW w AS (PARTITION BY batch ORDER BY vec_id)),
u AS (SELECT vec_id, batch, generate_subscripts(state, 1) AS dim, unnest(state) AS z, unnest(sh) AS zs, unnest(action) AS a, ok, oks FROM p),
m AS (SELECT *, avg(z) OVER (PARTITION BY batch, dim) AS mu, z * 0.9::DOUBLE + a * 0.1::DOUBLE AS zw FROM u),
x AS (SELECT vec_id, 'shuffle' AS variant, sum(z * zs) / sqrt(sum(z * z) * sum(zs * zs)) AS cos, sum((z - mu) * (zs - mu)) / sqrt(sum((z - mu) * (z - mu)) * sum((zs - mu) * (zs - mu))) AS cos_c,
    sqrt(sum((z - zs) * (z - zs))) / (sqrt(sum(z * z)) + 1e-8) AS rel FROM m WHERE oks GROUP BY 1
  UNION ALL SELECT vec_id, 'swap', sum(z * zw) / sqrt(sum(z * z) * sum(zw * zw)), sum((z - mu) * (zw - mu)) / sqrt(sum((z - mu) * (z - mu)) * sum((zw - mu) * (zw - mu))),
    sqrt(sum((z - zw) * (z - zw))) / (sqrt(sum(z * z)) + 1e-8) FROM m WHERE ok GROUP BY 1),
st AS (SELECT variant, count(*) AS n, avg(cos) AS cos_mean, stddev_pop(cos) AS cos_std, avg(cos_c) AS cos_c_mean, stddev_pop(cos_c) AS cos_c_std, avg(rel) AS rel_mean, stddev_pop(rel) AS rel_std FROM x GROUP BY 1)"""
_STATS = ["cos_mean", "cos_std", "cos_c_mean", "cos_c_std", "rel_mean", "rel_std"]


@query("latent_sensitivity", f"WITH {LAT_SQL} SELECT variant, n, {', '.join(f'round({c}, 6) AS {c}' for c in _STATS)} FROM st")
def _(spark, sf):
    return rounded(ev.latent_sensitivity(latents(spark, sf), ["shuffle", "swap"]), _STATS)


@query("sensitivity_ratio", f"""WITH {LAT_SQL}, r AS (SELECT greatest(1 - max(cos_c_mean) FILTER (variant = 'shuffle'), 0) / greatest(1 - max(cos_c_mean) FILTER (variant = 'swap'), 0) AS ratio FROM st)
  SELECT round(ratio, 4) AS ratio, CASE WHEN ratio >= 3 THEN 'tactile' WHEN ratio > 0.3 THEN 'mixed' ELSE 'vision-language' END AS band FROM r""")
def _(spark, sf):
    return rounded(ev.sensitivity_ratio(ev.latent_sensitivity(latents(spark, sf), ["shuffle", "swap"])), ["ratio"], 4)


CUST_SQL = "cu AS (SELECT c_custkey, c_nationkey, any_value(c_acctbal) AS x, sum(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


def customers(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_custkey", "c_nationkey").agg(F.first("c_acctbal").alias("x"), F.sum("o_totalprice").alias("y"))


@query("pearson", f"WITH {CUST_SQL} SELECT c_nationkey, round(corr(x, y), 6) AS r, count(*) AS n FROM cu GROUP BY 1")
def _(spark, sf):
    return rounded(ev.pearson(customers(spark, sf), F.col("x"), F.col("y"), ["c_nationkey"]), ["r"])


# Equal readings keep distinct ranks in id order.
@query("spearman", f"""WITH {CUST_SQL}, q AS (SELECT c_custkey, round(x, -2) AS x, round(y, -3) AS y FROM cu),
  r AS (SELECT row_number() OVER (ORDER BY x, c_custkey) AS rx, row_number() OVER (ORDER BY y, c_custkey) AS ry FROM q) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""")
def _(spark, sf):
    q = customers(spark, sf).select("c_custkey", F.round("x", -2).alias("x"), F.round("y", -3).alias("y"))
    return rounded(ev.spearman(q, "x", "y", "c_custkey"), ["rho"])


def nations(spark, sf):
    return customers(spark, sf).groupBy("c_nationkey").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _draws(m):
    """SQL twin of the draws: units numbered from 0, each once per resample."""
    return f"""{CUST_SQL}, nt AS (SELECT c_nationkey, avg(x) AS x, avg(y) AS y FROM cu GROUP BY 1), un AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS n FROM nt),
dr AS (SELECT un.*, r, ('0x' || substr(md5('0|' || r || '|' || i), 1, 15))::BIGINT AS h FROM un, range(0, {m}) t(r))"""


@query("permutation_test", f"""WITH {_draws(200_000)}, pm AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY h, i) - 1 AS at_ FROM dr),
  st AS (SELECT r, corr(pm.x, un.y) AS s FROM pm JOIN un ON un.i = at_ GROUP BY 1), o AS (SELECT corr(x, y) AS s, count(*) AS n FROM un)
  SELECT round(any_value(o.s), 6) AS observed, round((count(*) FILTER (abs(st.s) >= abs(o.s) - 1e-12) + 1) / (count(*) + 1), 9) AS p, any_value(n) AS n, count(*) AS resamples FROM st, o""")
def _(spark, sf):
    out = rs.permutation_test(nations(spark, sf), "c_nationkey", "x", "y", portable=True)
    return out.withColumns({"observed": F.round("observed", 6), "p": F.round("p", 9)})


@query("sign_flip_test", f"""WITH {_draws(20_000)}, st AS (SELECT r, avg((x - y / 300) * CASE WHEN h & 1 = 0 THEN 1 ELSE -1 END) AS s FROM dr GROUP BY 1), o AS (SELECT avg(x - y / 300) AS s, count(*) AS n FROM un)
  SELECT round(any_value(o.s), 4) AS observed, round((count(*) FILTER (abs(st.s) >= abs(o.s) - 1e-12) + 1) / (count(*) + 1), 9) AS p, any_value(n) AS n FROM st, o""")
def _(spark, sf):
    out = rs.sign_flip_test(nations(spark, sf).withColumn("d", F.col("x") - F.col("y") / 300), "c_nationkey", "d", portable=True)
    return out.withColumns({"observed": F.round("observed", 4), "p": F.round("p", 9)})


@query("bootstrap_ci", f"""WITH {_draws(10_000)}, st AS (SELECT r, corr(un.x, un.y) AS s FROM dr JOIN un ON un.i = h % dr.n GROUP BY 1)
  SELECT round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi, count(*) AS resamples FROM st""")
def _(spark, sf):
    return rounded(rs.bootstrap_ci(nations(spark, sf), "c_nationkey", "x", "y", portable=True), ["lo", "hi"])


REGION_SQL = f"""{CUST_SQL}, rg AS (SELECT n_regionkey AS i, avg(x) AS x, avg(y) AS y FROM cu JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


@query("exact_permutation_test", f"""WITH {REGION_SQL}, p AS (SELECT row_number() OVER () AS k, [a.i, b.i, c.i, d.i, e.i] AS s FROM rg a JOIN rg b ON b.i <> a.i JOIN rg c ON c.i NOT IN (a.i, b.i)
    JOIN rg d ON d.i NOT IN (a.i, b.i, c.i) JOIN rg e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
  u AS (SELECT k, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS j FROM p), c AS (SELECT k, corr(x.x, y.y) AS r FROM u JOIN rg x ON x.i = u.i JOIN rg y ON y.i = u.j GROUP BY 1),
  o AS (SELECT corr(x, y) AS r FROM rg) SELECT round(any_value(o.r), 6) AS observed, round(avg((abs(c.r) >= abs(o.r) - 1e-12)::INT), 6) AS p, count(*) AS total FROM c, o""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = customers(spark, sf).join(n, "c_nationkey").groupBy("n_regionkey").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(rs.exact_permutation_test(r, "n_regionkey", "x", "y"), ["observed", "p"])


@query("derangement_pair", """WITH h AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('7|' || conv_id || '|' || turn), conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations)
  SELECT a.conv_id, a.turn, b.conv_id AS partner_conv, b.turn AS partner_turn FROM h a JOIN h b ON b.i = (a.i + 1) % a.n""")
def _(spark, sf):
    d = rs.derangement_pair(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], seed=7)
    other = d.select(F.col("_i").alias("partner_i"), F.col("conv_id").alias("partner_conv"), F.col("turn").alias("partner_turn"))
    return d.join(other, "partner_i").select("conv_id", "turn", "partner_conv", "partner_turn")


@query("holm_adjust", f"""WITH {CUST_SQL}, p AS (SELECT c_nationkey, round(abs(corr(x, y)) / 10, 6) AS p FROM cu GROUP BY 1),
  a AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, c_nationkey) + 1) * p, 1) AS a FROM p)
  SELECT c_nationkey, p, round(max(a) OVER (ORDER BY p, c_nationkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM a""")
def _(spark, sf):
    p = ev.pearson(customers(spark, sf), F.col("x"), F.col("y"), ["c_nationkey"]).select("c_nationkey", F.round(F.abs("r") / 10, 6).alias("p"))
    return rounded(ev.holm_adjust(p, order=["c_nationkey"]), ["p_holm"])
