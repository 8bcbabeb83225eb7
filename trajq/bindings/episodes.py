"""Queries for episode selection, splits, reshaping and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajq.bindings.data import FRAMES_SQL, frames, table
from trajq.bindings.motion import ISLANDS_SQL, conversation_episodes, series
from trajq.operators import dataset as ds
from trajq.plans.ordered import runs

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("task_name", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' END AS name,
    CASE WHEN doc_id % 10 = 0 THEN '' || doc_id ELSE lang || '_' || source || '_-' || doc_id END AS folder FROM documents)
  SELECT doc_id, coalesce(nullif(name, ''), nullif(regexp_replace(regexp_replace(folder, '[0-9]+$', ''), '[_-]+$', ''), ''), folder) AS task FROM d""")
def _(spark, sf):
    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    name = F.when(i % 3 == 0, F.col("source")).when(i % 3 == 1, "")
    folder = F.when(i % 10 == 0, text).otherwise(F.concat("lang", F.lit("_"), "source", F.lit("_-"), text))
    return table(spark, sf, "documents").select("doc_id", ds.task_name(name, folder).alias("task"))


@query("task_prompt", """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text WHEN conv_id % 3 = 1 THEN role ELSE 'Perform the task.' END AS prompt FROM conversations""")
def _(spark, sf):
    i = F.col("conv_id")
    steps = F.when(i % 3 == 0, F.array("text", "role")).when(i % 3 == 1, F.array().cast("array<string>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", ds.task_prompt(steps, F.when(i % 3 == 1, F.col("role")).otherwise("")).alias("prompt"))


query("task_prompt_turns", SQL["task_prompt"])(QUERIES["task_prompt"])  # a name it also had


@query("task_to_prompt", """SELECT o_orderkey, n_name AS prompt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    tasks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("task"))
    f = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ds.task_to_prompt(f.select("o_orderkey", F.col("c_nationkey").alias("task_index")), tasks).select("o_orderkey", "prompt")


FILES_SQL = """files AS (SELECT user_id * 100 + day(ts) AS recording_id, CASE WHEN event_id % 2 = 0 THEN 'nested/' ELSE '' END || event_type AS path, event_type AS file FROM events)"""


def files(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("recording_id"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "nested/").otherwise(""), "event_type").alias("path"), F.col("event_type").alias("file"))


@query("file_inventory", f"""WITH {FILES_SQL}, h AS (SELECT recording_id, list(DISTINCT file) AS have FROM files GROUP BY 1),
  m AS (SELECT recording_id, list_filter(['click', 'view', 'purchase'], lambda x: NOT list_contains(have, x)) AS missing FROM h)
  SELECT recording_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM m""")
def _(spark, sf):
    out = ds.file_inventory(files(spark, sf), ["click", "view", "purchase"])
    return out.withColumn("missing", F.array_join("missing", ","))


SQL["file_diff"] = SQL["file_inventory"].replace("SELECT recording_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM m",
                                                  "SELECT recording_id, unnest(missing) AS missing FROM m")


@query("file_diff")
def _(spark, sf):
    out = ds.file_inventory(files(spark, sf), ["click", "view", "purchase"])
    return out.select("recording_id", F.explode("missing").alias("missing"))


@query("first_layout", f"""WITH {FILES_SQL} SELECT recording_id, coalesce(max(path) FILTER (path = 'nested/click'), max(path) FILTER (path = 'click')) AS a,
  coalesce(max(path) FILTER (path = 'view'), max(path) FILTER (path = 'nested/view')) AS b FROM files GROUP BY 1""")
def _(spark, sf):
    return ds.first_layout(files(spark, sf), {"a": ["nested/click", "click"], "b": ["view", "nested/view"]}, file="path")


EPS_SQL = """e AS (SELECT conv_id, count(*) AS n, 'episode_' || conv_id AS name, '' || conv_id AS episode_id FROM conversations GROUP BY 1)"""


def eps(spark, sf):
    return conversation_episodes(spark, sf).withColumn("episode_id", F.col("conv_id").cast("string"))


@query("drop_reasons", f"""WITH {EPS_SQL}, r AS (SELECT conv_id, n AS ra, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE n - conv_id % 2 END AS rs, n + conv_id % 4 - 1 AS want,
    CASE WHEN conv_id % 7 = 0 THEN 'missing_action.csv' END AS m1, CASE WHEN conv_id % 9 = 0 THEN 'missing_video=wrist' END AS m2 FROM e)
  SELECT conv_id, CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL THEN concat_ws('|', m1, m2) ELSE concat_ws('|', CASE WHEN ra <= 0 THEN 'empty_csv_action' END,
    CASE WHEN ra > want OR want - ra > 1 THEN 'row_mismatch_action=' || ra || '_expected_' || want END, CASE WHEN rs <= 0 THEN 'empty_csv_state' END,
    CASE WHEN rs > want OR want - rs > 1 THEN 'row_mismatch_state=' || rs || '_expected_' || want END,
    CASE WHEN ra <> rs THEN 'csv_row_count_disagreement={{''action'': ' || ra || ', ''state'': ' || rs || '}}' END) END AS reasons FROM r""")
def _(spark, sf):
    i, n = F.col("conv_id"), F.col("length")
    e = eps(spark, sf).select(
        "conv_id", n.alias("rows_action"), F.when(i % 5 == 0, 0).otherwise(n - i % 2).alias("rows_state"), (n + i % 4 - 1).alias("total_frames"),
        F.when(i % 7 == 0, F.array(F.lit("state.csv"))).otherwise(F.array(F.lit("state.csv"), F.lit("action.csv"))).alias("files"),
        F.when(i % 9 == 0, F.array(F.lit("head"))).otherwise(F.array(F.lit("head"), F.lit("wrist"))).alias("videos"))
    out = ds.drop_reasons(e, ["action.csv", "state.csv"], ["head", "wrist"])
    return out.select("conv_id", F.array_join("reasons", "|").alias("reasons"))


EXCL_SQL = "x AS (SELECT CASE WHEN quality = 1 THEN 'episode_' || doc_id ELSE '' || doc_id END AS item FROM labels WHERE toxic = 1 OR doc_id % 6 = 0)"


def excluded(spark, sf):
    i = F.col("doc_id").cast("string")
    return table(spark, sf, "labels").where("toxic = 1 OR doc_id % 6 = 0").select(F.when(F.col("quality") == 1, F.concat(F.lit("episode_"), i)).otherwise(i).alias("item"))


@query("exclude_episodes", f"WITH {EPS_SQL}, {EXCL_SQL} SELECT conv_id, name IN (SELECT item FROM x) OR episode_id IN (SELECT item FROM x) AS dropped FROM e")
def _(spark, sf):
    kept, dropped = ds.exclude_episodes(eps(spark, sf), excluded(spark, sf))
    return kept.select("conv_id", F.lit(False).alias("dropped")).unionByName(dropped.select("conv_id", F.lit(True).alias("dropped")))


@query("exclude_anomalous", """WITH e AS (SELECT DISTINCT conv_id % 3 AS dataset, conv_id // 3 AS episode_index FROM conversations),
  a AS (SELECT doc_id % 3 AS dataset, doc_id // 3 + CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS episode_index FROM labels WHERE doc_id % 4 = 1),
  z AS (SELECT dataset, max((episode_index = 0)::INT) AS zero FROM a GROUP BY 1),
  g AS (SELECT dataset, episode_index - CASE WHEN zero = 1 THEN 0 ELSE 1 END AS episode_index FROM a JOIN z USING (dataset))
  SELECT * FROM e WHERE (dataset, episode_index) NOT IN (SELECT (dataset, episode_index) FROM g)""")
def _(spark, sf):
    e = table(spark, sf, "conversations").select((F.col("conv_id") % 3).alias("dataset"), F.floor(F.col("conv_id") / 3).alias("episode_index")).distinct()
    i = F.col("doc_id")
    a = table(spark, sf, "labels").where("doc_id % 4 = 1").select((i % 3).alias("dataset"), (F.floor(i / 3) + F.when(i % 3 == 1, 0).otherwise(1)).alias("episode_index"))
    return ds.exclude_anomalous(e, a)


SPLIT_SQL = "sp AS (SELECT doc_id AS uuid, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN quality = 1 THEN 'train' ELSE 'validation' END AS split FROM labels)"


def splits(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("uuid"), F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("quality") == 1, "train").otherwise("validation").alias("split"))


@query("split_select", f"WITH {SPLIT_SQL} SELECT doc_id AS uuid, lang FROM documents WHERE doc_id IN (SELECT uuid FROM sp WHERE split = 'validation')")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uuid"), "lang")
    return ds.split_select(d, ds.translate_splits(splits(spark, sf)), "val")


@query("split_disjoint", f"""WITH {SPLIT_SQL}, u AS (SELECT * FROM sp UNION ALL SELECT uuid, 'train' FROM sp WHERE uuid % 9 = 0)
  SELECT uuid, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM u GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    s = splits(spark, sf)
    return ds.split_disjoint(s.unionByName(s.where("uuid % 9 = 0").withColumn("split", F.lit("train"))))


@query("stride_sample", """WITH e AS (SELECT conv_id AS episode_index, count(*) * 20 AS length FROM conversations GROUP BY 1),
  o AS (SELECT *, sum(length) OVER (ORDER BY episode_index) - length AS f FROM e)
  SELECT episode_index, k AS frame_index, (f + k)::BIGINT AS row FROM (SELECT *, unnest(range(0, length - 50, 5)) AS k FROM o)""")
def _(spark, sf):
    e = eps(spark, sf).select(F.col("conv_id").alias("episode_index"), (F.col("length") * 20).alias("length"))
    return ds.stride_sample(e)


@query("repack", "SELECT event_id AS id, value AS reading, event_type AS kind FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.struct("value", F.struct("event_type").alias("meta")).alias("obs"))
    r = ds.repack(e, {"key": "event_id", "sample": {"reading": "obs/value", "extra": "obs/none", "kind": "obs/meta/event_type"}}, optional=["obs/none"])
    return r.select(F.col("key").alias("id"), "sample.reading", "sample.kind")


@query("rename_by_regex", "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    r = ds.rename_by_regex(o, {"o_order(date|status|priority)": None, "o_(.*)": r"order/\1"})
    return r.select("order.orderkey", "order.custkey", "order.totalprice")


@query("column_alias", "SELECT p_partkey, p_size::DOUBLE AS x, round(p_retailprice * 0.5, 6) AS grip FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    v = ds.column_alias(p, [("size_mm", "p_size"), ("p_retailprice", "price")], last_scale=0.5)
    return p.select("p_partkey", v[0].alias("x"), F.round(v[1], 6).alias("grip"))


@query("drop_by_type", "SELECT * EXCLUDE (l_returnflag, l_linestatus, l_shipdate) FROM lineitem")
def _(spark, sf):
    """Numbers only: neither text nor dates."""
    return ds.drop_by_type(ds.drop_by_type(table(spark, sf, "lineitem")), (T.TimestampType, T.TimestampNTZType))


@query("concat_datasets", """SELECT doc_id AS id, n_chars, NULL AS turn, 'docs' AS norm_group, 0 AS dataset_order FROM documents
  UNION ALL SELECT conv_id, NULL, turn, 'chats', 1 FROM conversations""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn")
    return ds.concat_datasets({"docs": d, "chats": c})


@query("match_by_unique_length", """WITH e AS (SELECT conv_id AS episode_index, conv_id % 20 AS uuid, count(*) AS length FROM conversations GROUP BY 1),
  r AS (SELECT conv_id * 10 AS run_start, conv_id % 20 AS uuid, count(*) - (max(conv_id) % 6 = 0)::INT AS run_len FROM conversations GROUP BY conv_id),
  ec AS (SELECT uuid, length, count(*) AS n_episodes, min(episode_index) AS e FROM e GROUP BY 1, 2), rc AS (SELECT uuid, run_len AS length, count(*) AS n_runs, min(run_start) AS s FROM r GROUP BY 1, 2)
  SELECT uuid, length, coalesce(n_episodes, 0) AS n_episodes, coalesce(n_runs, 0) AS n_runs, CASE WHEN n_episodes = 1 AND n_runs = 1 THEN e END AS episode_index,
    CASE WHEN n_episodes = 1 AND n_runs = 1 THEN s END AS run_start FROM ec FULL JOIN rc USING (uuid, length)""")
def _(spark, sf):
    e = eps(spark, sf).select(F.col("conv_id").alias("episode_index"), (F.col("conv_id") % 20).alias("uuid"), "length")
    r = e.select("uuid", (F.col("episode_index") * 10).alias("run_start"), (F.col("length") - (F.col("episode_index") % 6 == 0).cast("int")).alias("run_len"))
    good, bad = ds.match_by_unique_length(r, e)
    one = F.lit(1).cast("bigint")
    return good.withColumns({"n_episodes": one, "n_runs": one}).unionByName(bad, allowMissingColumns=True)


@query("paired_reports", f"""WITH {FRAMES_SQL}, a AS (SELECT vec_id, state AS t FROM frames WHERE vec_id % 10 <> 0),
  b AS (SELECT vec_id, list_transform(state, lambda v: v + CASE WHEN vec_id % 17 = 0 THEN 0.01 ELSE 0 END) AS t FROM frames WHERE vec_id % 11 <> 0)
  SELECT count(*) FILTER (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL) AS paired, count(*) FILTER (b.vec_id IS NULL) AS only_before, count(*) FILTER (a.vec_id IS NULL) AS only_after,
    count(*) FILTER (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AND a.vec_id % 17 = 0) AS target_mismatch, 0::BIGINT AS provenance_mismatch FROM a FULL JOIN b ON a.vec_id = b.vec_id""")
def _(spark, sf):
    f = frames(spark, sf).select("vec_id", F.col("state").alias("target"), F.lit("run").alias("seed"))
    b = f.where("vec_id % 11 <> 0").withColumn("target", F.transform("target", lambda v: v + F.when(F.col("vec_id") % 17 == 0, 0.01).otherwise(0.0)))
    return ds.paired_reports(f.where("vec_id % 10 <> 0"), b, ["vec_id"], provenance=["seed"])


@query("optional_view_join", """SELECT d.doc_id, coalesce(quality, -1) AS quality, quality IS NOT NULL AS quality_mask, coalesce(toxic, -1) AS toxic, toxic IS NOT NULL AS toxic_mask
  FROM documents d LEFT JOIN labels a ON d.doc_id = a.doc_id LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) b ON d.doc_id = b.doc_id""".replace(
    "coalesce(quality, -1)", "coalesce(a.quality, -1)").replace("quality IS NOT NULL", "a.quality IS NOT NULL").replace(
    "coalesce(toxic, -1)", "coalesce(b.toxic, -1)").replace("toxic IS NOT NULL", "b.toxic IS NOT NULL"))
def _(spark, sf):
    labels = table(spark, sf, "labels")
    views = {"quality": (labels, "quality"), "toxic": (labels.where("doc_id % 2 = 0"), "toxic")}
    return ds.optional_view_join(table(spark, sf, "documents").select("doc_id"), views, ["doc_id"], F.lit(-1))


@query("dataset_info", """SELECT count(*) AS total_episodes, sum(n_chars % 500 + 1)::BIGINT AS total_frames, count(DISTINCT lang) AS total_tasks, ceil(count(*) / 1000)::BIGINT AS total_chunks,
  ceil(sum(n_chars * 100) / 1048576.0)::BIGINT AS data_files_size_in_mb, ceil(sum(n_chars * 7000) / 1048576.0)::BIGINT AS video_files_size_in_mb, '0:' || count(*) AS train_range FROM documents""")
def _(spark, sf):
    n = F.col("n_chars")
    e = table(spark, sf, "documents").select((n % 500 + 1).alias("length"), F.col("lang").alias("task"), (n * 100).alias("data_bytes"), (n * 7000).alias("video_bytes"))
    return ds.dataset_info(e)


_PCT = ", ".join(f"floor(quantile_cont(n, {q}) FILTER (kind = '{k}'))::BIGINT AS {k}_p{int(q * 100)}" for k in ("first", "later") for q in (0.0, 0.1, 0.5, 0.9, 1.0))


@query("segment_summary", f"""WITH {ISLANDS_SQL}, r AS (SELECT recording_id, g, min(idx) AS s, count(*) AS n FROM isl GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN s = min(s) OVER (PARTITION BY recording_id) THEN 'first' ELSE 'later' END AS kind, count(*) OVER (PARTITION BY recording_id) AS c FROM r),
  a AS (SELECT count(DISTINCT recording_id) AS trajectories, count(*) AS n_rows, sum(ok::INT)::BIGINT AS legal, avg(ok::INT) AS legal_share,
    sum((engaged AND ok)::INT) / sum(ok::INT) AS both_engaged_share, sum((sample_idx % 3 = 0 AND ok)::INT) / sum(ok::INT) AS holding_share FROM series),
  p AS (SELECT count(*) AS n_runs, coalesce(sum(n) FILTER (kind = 'later'), 0) / sum(n) AS later_share, count(DISTINCT recording_id) FILTER (c > 1) AS multi_run, {_PCT} FROM k)
  SELECT * FROM a, p""")
def _(spark, sf):
    s = series(spark, sf).withColumnsRenamed({"ok": "legal", "engaged": "both_engaged"}).withColumn("holding", F.col("sample_idx") % 3 == 0)
    return ds.segment_summary(s, runs(s.where("legal"), ["recording_id"], "idx", size=16))


@query("incremental_batch", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    return ds.incremental_batch(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("quality = 1"), ["doc_id"])


@query("parse_metric_log", """SELECT event_id::DOUBLE AS step, value AS stage1_nce, value / 2 AS stage1_recon, value * 2 AS stage1_total FROM events WHERE event_id % 4 <> 1""")
def _(spark, sf):
    v = F.col("value")
    line = F.concat(
        F.lit("INFO step="), F.col("event_id").cast("string"), F.lit(" loss: stage1_nce="), v.cast("string"), F.lit(" stage1_recon="), (v / 2).cast("string"),
        F.when(F.col("event_id") % 4 == 1, "").otherwise(F.concat(F.lit(" stage1_total="), (v * 2).cast("string"))))
    return ds.parse_metric_log(table(spark, sf, "events").select(line.alias("value")))


@query("roll_partner", """WITH e AS (SELECT vec_id, vec_id // 32 AS batch, vec_id % 5 <> 0 AS ok FROM embeddings)
  SELECT vec_id, coalesce(lead(vec_id) OVER w, first(vec_id) OVER w) AS partner, ok AND coalesce(lead(ok) OVER w, first(ok) OVER w) AS pair_valid
  FROM e WINDOW w AS (PARTITION BY batch ORDER BY vec_id)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 32).alias("batch"))
    return ds.roll_partner(e, "batch", "vec_id", F.col("vec_id"), F.col("vec_id") % 5 != 0).drop("batch")
