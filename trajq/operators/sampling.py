"""Seeded sampling and top-k selection.

Order by a hash of the row's own key: the same rows are chosen whatever the partitioning, and a
``row_number <= k`` filter lets Spark cut every group to k rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.plans.lineage import measured


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random order of rows by their key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, groups: Sequence[str], id_cols: Sequence[str], k: int, *, seed: int = 42) -> DataFrame:
    """Up to k distinct ids per group with all their rows, without replacement.

    Only the distinct ids are ranked; the rows themselves are not sorted.
    """
    keys = [*groups, *id_cols]
    w = Window.partitionBy(*groups).orderBy(hash_order(keys, seed), *id_cols)
    ids = df.select(*keys).distinct().withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
    chosen = measured(ids).alias("chosen")
    same = [F.col(f"all.{c}").eqNullSafe(F.col(f"chosen.{c}")) for c in keys]
    return df.alias("all").join(chosen, same, "left_semi")


def sample_n(df: DataFrame, id_cols: Sequence[str], n: int, *, seed: int = 42) -> DataFrame:
    """n rows of the whole table in hash order (a distributed top-n)."""
    return df.orderBy(hash_order(id_cols, seed), *id_cols).limit(n)


def weighted_mix(datasets: Mapping[str, tuple[DataFrame, float]], id_cols: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Mix datasets in the proportion of their weights (which sum to 1), tagged ``dataset``.

    The dataset whose share runs out first is taken whole; of the others a deterministic hash
    fraction is kept.
    """
    total = sum(w for _, w in datasets.values())
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"weights sum to {total}, expected 1")
    out = None
    for name, (df, weight) in datasets.items():
        part = df.withColumns({"dataset": F.lit(name), "_w": F.lit(float(weight))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    sizes = out.groupBy("dataset").agg(F.count("*").alias("_n"), F.first("_w").alias("_wt"))
    limit = Window.partitionBy(F.lit(0))  # one row per dataset
    sizes = sizes.withColumn("_m", F.min(F.col("_n") / F.col("_wt")).over(limit))
    sizes = sizes.select("dataset", (F.col("_wt") * F.col("_m") / F.col("_n")).alias("_keep"))
    u = F.conv(F.substring(hash_order(["dataset", *id_cols], seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return out.join(F.broadcast(sizes), "dataset").where(u < F.col("_keep")).drop("_w", "_keep")  # one row per dataset


def top_noise(candidates: DataFrame, *, keys: Sequence[str] = ("recording_id", "hand"), k: int = 5) -> DataFrame:
    """Up to k candidates per hand by duration times peak, earlier first on a tie."""
    score = F.col("dur") * F.greatest(F.col("peak"), F.lit(1e-6))
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col("start"), F.col("end"))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_longest(durations: DataFrame, *, duration: str = "duration", name: str = "recording_id", cap: float = 30.0, n: int = 20) -> DataFrame:
    """The n longest recordings over the cap."""
    return durations.where(F.col(duration) > cap).orderBy(F.col(duration).desc(), F.col(name)).limit(n)


def first_n_accepted(episodes: DataFrame, accepted: Column, n: int, *, name: str = "name") -> DataFrame:
    """First n accepted episodes by name, with the rejected ones; fewer than n accepted is an error."""
    e = episodes.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    first = e.where("accepted").orderBy(name).limit(n).select(name, F.lit(True).alias("chosen"))
    short = first.agg(F.count("*") < n).scalar()
    out = e.join(first, name, "left").withColumns({"chosen": F.coalesce("chosen", F.lit(False)), "_short": short})
    checked = F.when(F.col("_short"), F.raise_error(F.lit(f"fewer than {n} accepted episodes"))).otherwise(F.col("chosen"))
    return out.withColumn("chosen", checked).drop("_short")


def max_energy_clip(df: DataFrame, energy: Column, *, episode: str = "episode_index", order: str = "pos", length: int = 48, lead: int = 24) -> DataFrame:
    """The ``length`` scored rows around the strongest one, within its episode.

    ``order`` numbers the scored rows of an episode from 0.
    """
    e = df.withColumn("_e", energy)
    peak = e.agg(F.max(F.struct("_e", (-F.col(episode)).alias("ne"), (-F.col(order)).alias("no"))).alias("p"))
    peak = peak.select((-F.col("p.ne")).alias(episode), (-F.col("p.no")).alias("_at"))
    sizes = e.groupBy(episode).agg((F.max(order) + 1).alias("_len"))
    peak = F.broadcast(peak).join(sizes, episode)  # one row
    start = F.greatest(F.lit(0), F.least(F.col("_at") - lead, F.col("_len") - length))
    near = e.join(F.broadcast(peak.select(episode, start.alias("_s"))), episode)
    return near.where((F.col(order) >= F.col("_s")) & (F.col(order) < F.col("_s") + length)).drop("_e", "_s")
