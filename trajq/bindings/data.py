"""The driver's tables in the roles the operators expect.

events -> recordings (user) x streams (event type); embeddings -> episodes (label) of vector
frames; conversations -> short episodes; documents, labels, pages, orders -> inventories, splits,
lookups and durations. Each view has a SQL twin for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.functions.layout import PADS
from trajq.plans.ordered import row_index

STREAMS = ("click", "view", "purchase", "signup", "error")
HALF_DAY_NS = 43_200_000_000_000
FIVE_DAYS_NS = 432_000_000_000_000
DAY_NS = 86_400_000_000_000
#: Glove samples carry epoch times.
EPOCH_NS = 1_700_000_000_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_us(ts: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone is."""
    return F.expr(
        f"unix_date(to_date({ts})) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L"
        f" + cast(extract(second from {ts}) * 1000000 as bigint)"
    )


def streams(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("recording_id"),
        F.col("event_type").alias("stream"),
        F.col("event_id").alias("sample_idx"),
        (epoch_us("ts") * 1000).alias("t_ns"),
        "value",
    )


STREAMS_SQL = """streams AS (
  SELECT user_id AS recording_id, event_type AS stream, event_id AS sample_idx, epoch_us(ts) * 1000 AS t_ns, value
  FROM events)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vector frames: episode_index, frame_index, vec_id, state[32], action[32]."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("episode_index"), "vec_id",
        F.col("embedding").cast("array<double>").alias("v"),
    )
    e = row_index(e, ["episode_index"], "vec_id", "frame_index", size=100_000)
    return e.select("episode_index", "frame_index", "vec_id", F.slice("v", 1, 32).alias("state"), F.slice("v", 33, 32).alias("action"))


FRAMES_SQL = """frames AS (
  SELECT label::BIGINT AS episode_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
         vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS state,
         list_transform(embedding[33:64], lambda x: x::DOUBLE) AS action
  FROM embeddings)"""

WINDOW_SQL = """per AS (SELECT recording_id, stream, min(t_ns) a, max(t_ns) b, count(*) n FROM streams GROUP BY 1, 2),
win AS (SELECT recording_id, max(a) AS start_ns, min(b) AS end_ns, count(*) AS n_streams, min(n) AS min_samples
        FROM per GROUP BY 1)"""

GRID_SQL = f"""{WINDOW_SQL},
good AS (SELECT * FROM win WHERE n_streams = 5 AND min_samples >= 2 AND end_ns - start_ns >= 1000000000),
grid AS (SELECT recording_id, k AS tick, start_ns + k * {HALF_DAY_NS} AS t_ns
         FROM (SELECT *, unnest(range(0, (end_ns - start_ns) // {HALF_DAY_NS} + 2)) AS k FROM good)
         WHERE start_ns + k * {HALF_DAY_NS} < end_ns)"""

NEAR_SQL = f"""{GRID_SQL},
names AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS stream, unnest([0, 1, 2, 3, 4]) AS ord),
ticks AS (SELECT grid.*, names.* FROM grid, names),
prv AS (SELECT q.recording_id, q.stream, q.ord, q.tick, q.t_ns, s.t_ns AS pt, s.sample_idx AS pi
        FROM ticks q ASOF LEFT JOIN streams s
        ON q.recording_id = s.recording_id AND q.stream = s.stream AND q.t_ns > s.t_ns),
both_ AS (SELECT p.*, s.t_ns AS nt, s.sample_idx AS ni
        FROM prv p ASOF LEFT JOIN streams s
        ON p.recording_id = s.recording_id AND p.stream = s.stream AND p.t_ns <= s.t_ns),
near AS (SELECT recording_id, stream, ord, tick, t_ns,
         CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t_ns - pt <= nt - t_ns) THEN pi ELSE ni END AS idx,
         CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t_ns - pt <= nt - t_ns) THEN t_ns - pt ELSE nt - t_ns END AS gap
         FROM both_)"""


SLOT_IDS = PADS


def tactile(spark: SparkSession, sf: str) -> DataFrame:
    """Glove samples: each vector is one frame of one hand, 15 pads of 2 x 2 cells.

    Some fingers of some recordings are silent, as a broken glove would be.
    """
    e = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("recording_id"),
        F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("hand"),
        "vec_id", F.col("embedding").cast("array<double>").alias("v"),
    )
    e = row_index(e, ["recording_id", "hand"], "vec_id", "sample_idx", size=100_000)
    slots = F.array(*[F.lit(s) for s in SLOT_IDS])
    e = e.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(14))))
    dead = (F.col("recording_id") + F.floor(F.col("p") / 3)) % 4 == 0
    x = F.slice("v", F.col("p") * 4 + 1, 4)
    return e.select(
        "recording_id", "hand", F.get(slots, F.col("p")).alias("pad"), "sample_idx",
        (F.col("sample_idx") * 100_000_000 + EPOCH_NS).alias("t_ns"), F.lit(2).alias("h"), F.lit(2).alias("w"),
        F.when(dead, F.array_repeat(F.lit(0.0), 4)).otherwise(x).alias("force"),
    )


TACTILE_SQL = f"""tactile AS (
  SELECT recording_id, hand, ([0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 15, 16, 18])[p + 1] AS pad, sample_idx, {EPOCH_NS} + sample_idx * 100000000 AS t_ns,
    CASE WHEN (recording_id + p // 3) % 4 = 0 THEN [0.0::DOUBLE, 0, 0, 0] ELSE list_transform(embedding[p * 4 + 1:p * 4 + 4], lambda x: x::DOUBLE) END AS force
  FROM (SELECT *, row_number() OVER (PARTITION BY label, hand ORDER BY vec_id) - 1 AS sample_idx FROM
        (SELECT label::BIGINT AS recording_id, label, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, vec_id, embedding FROM embeddings)),
       range(0, 15) t(p)),
cells AS (SELECT recording_id, hand, pad, sample_idx, t_ns, generate_subscripts(force, 1) - 1 AS cell, unnest(force) AS x FROM tactile)"""
