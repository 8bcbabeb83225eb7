"""Ordered operators that do not put a whole recording into one task.

A window over ``partitionBy(recording)`` sorts every row of a recording in one task, which fails
once a single recording holds a large share of the data. All ordered work here is cut into
buckets of the order key instead: rows are windowed inside ``(keys, bucket)``, each bucket is
reduced to one summary row, the summaries (rows / bucket size of them) are scanned per key, and
the carried value comes back by an equi-join on ``(keys, bucket)``. Bucket edges are arithmetic on
the order key, so a recomputed task lands in the same bucket.

``size`` is in units of the order key: choose it so that one bucket holds at most about a million
rows (one hour of six 50 Hz streams, or a million frame indices).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
ROWS_PER_BUCKET = 1_000_000
HOUR_NS = 3_600_000_000_000


def bucket_start(order: Column, size: int) -> Column:
    """Start of the bucket of an integer order key (exact, no division)."""
    return order - F.pmod(order, F.lit(size).cast("bigint"))


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a bucket, dealt out by (keys, bucket).

    A window over (keys, bucket) is content with rows that an earlier join has dealt out by the keys
    alone, and would then sort a whole key in one task; hence the explicit repartition.
    """
    return df.repartition(*[F.col(k) for k in keys], F.col(BUCKET))


def _global_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    values: Mapping[str, Column],
    *,
    size: int = ROWS_PER_BUCKET,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Add, per output name, the last non-null value at (or strictly before) each row.

    ``backward`` looks the other way (the first non-null value at or after the row).
    ``order[0]`` is the integer key that is bucketed; further columns break ties.
    """
    order = _names(order)
    before = df.columns
    df, keys = _global_key(df, list(keys))
    d = df.withColumn(BUCKET, bucket_start(F.col(order[0]), size))
    sort = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    part = Window.partitionBy(*keys, BUCKET).orderBy(*sort)
    local = part.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = dealt(d, keys).withColumns({f"_l_{n}": F.last(v, ignorenulls=True).over(local) for n, v in values.items()})
    edge = F.min if backward else F.max
    summary = d.groupBy(*keys, BUCKET).agg(
        *[edge(F.when(v.isNotNull(), F.struct(*order, v.alias("_v")))).alias(f"_e_{n}") for n, v in values.items()]
    )
    step = F.col(BUCKET).desc() if backward else F.col(BUCKET).asc()
    outer = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, BUCKET, *[F.last(F.col(f"_e_{n}"), ignorenulls=True).over(outer)["_v"].alias(f"_c_{n}") for n in values]
    )
    out = rows.join(carry, [*keys, BUCKET], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in before if c not in values],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    values: Mapping[str, Column],
    *,
    size: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add inclusive running sums per key in order, bucket by bucket."""
    order = _names(order)
    before = df.columns
    df, keys = _global_key(df, list(keys))
    d = df.withColumn(BUCKET, bucket_start(F.col(order[0]), size))
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(d, keys).withColumns({f"_l_{n}": F.sum(v).over(local) for n, v in values.items()})
    totals = d.groupBy(*keys, BUCKET).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    outer = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BUCKET, *[F.sum(f"_t_{n}").over(outer).alias(f"_c_{n}") for n in values])
    out = rows.join(carry, [*keys, BUCKET], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in before if c not in values],
        *[
            (F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in values
        ],
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    name: str,
    *,
    size: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    out = running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, size=size)
    return out.withColumn(name, F.col(name) - 1)


def neighbours(
    df: DataFrame, keys: Sequence[str], index: str, *, back: int = 0, ahead: int = 0, size: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, list[str]]:
    """Bucket rows of a dense integer index together with the few rows around each bucket.

    Returns ``(rows, partition columns)``: every row is present in its own bucket (``_core``) and,
    when it lies within ``back``/``ahead`` of a neighbouring bucket, there as context. Windows that
    look at most that far are then exact inside one bucket, in a single shuffle; filter on
    ``_core`` afterwards.
    """
    size = max(size, back, ahead)
    own = bucket_start(F.col(index), size)
    offset = F.col(index) - own
    targets = F.array_compact(
        F.array(
            F.struct(own.alias("b"), F.lit(True).alias("c")),
            F.when(offset >= size - back, F.struct((own + size).alias("b"), F.lit(False).alias("c"))),
            F.when(offset < ahead, F.struct((own - size).alias("b"), F.lit(False).alias("c"))),
        )
    )
    rows = df.withColumn("_target", F.explode(targets)).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_target.b").alias(BUCKET), F.col("_target.c").alias("_core")
    )
    return dealt(rows, keys), [*keys, BUCKET]


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based position of each row in the total order of ``order``, without a global window.

    Rows are range-partitioned and sorted; the partition sizes (one row per partition) give the
    offsets. The assignment is checkpointed, so both uses of it see the same partitions.
    """
    placed = checkpoint_positions(df, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_off") + F.col("_pos"))
        .drop("_part", "_pos", "_off")
    )


def checkpoint_positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    from trajq.plans.lineage import checkpoint

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low33 = F.lit((1 << 33) - 1)
    return checkpoint(
        placed.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(low33)
        )
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    *,
    max_step: int = 1,
    size: int = ROWS_PER_BUCKET,
    rows: bool = False,
    agg: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Islands of rows whose index advances by at most ``max_step``.

    ``rows=False`` returns one row per island: keys, ``run_start, run_end, run_len`` and the
    ``agg`` columns, each ``(min|max|sum, expression)`` over the island; ``rows=True`` adds the
    three run columns to every row. Only the first and last island of a bucket can
    continue in another bucket, so at most two rows per bucket are linked across buckets.
    """
    keys, agg = list(keys), dict(agg or {})
    before = df.columns
    d = dealt(df.withColumn(BUCKET, bucket_start(F.col(index), size)), keys)
    w = Window.partitionBy(*keys, BUCKET).orderBy(index)
    fresh = F.coalesce((F.col(index) - F.lag(index).over(w) > max_step).cast("int"), F.lit(1))
    d = d.withColumn("_new", fresh).withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = d.groupBy(*keys, BUCKET, "_isl").agg(
        F.min(index).alias("_s"), F.max(index).alias("_e"), F.count("*").alias("_n"),
        *[getattr(F, f)(v).alias(n) for n, (f, v) in agg.items()],
    )
    pieces = pieces.withColumn("_last", F.max("_isl").over(Window.partitionBy(*keys, BUCKET)))
    is_edge = (F.col("_isl") == 1) | (F.col("_isl") == F.col("_last"))
    chain = Window.partitionBy(*keys).orderBy("_s")
    edges = pieces.where(is_edge)
    edges = edges.withColumn(
        "_brk", F.coalesce((F.col("_s") - F.lag("_e").over(chain) > max_step).cast("int"), F.lit(1))
    ).withColumn("_run", F.sum("_brk").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_run")
    edges = edges.select(
        *keys, BUCKET, "_isl", "_s", "_run",
        F.min("_s").over(whole).alias("run_start"),
        F.max("_e").over(whole).alias("run_end"),
        F.sum("_n").over(whole).alias("run_len"),
        *[getattr(F, f)(n).over(whole).alias(n) for n, (f, _) in agg.items()],
    )
    if not rows:
        inner = pieces.where(~is_edge).select(
            *keys, F.col("_s").alias("run_start"), F.col("_e").alias("run_end"), F.col("_n").alias("run_len"), *agg
        )
        return inner.unionByName(
            edges.where(F.col("_s") == F.col("run_start")).select(*keys, "run_start", "run_end", "run_len", *agg)
        )
    local = Window.partitionBy(*keys, BUCKET, "_isl")
    d = d.withColumns({
        "_s0": F.min(index).over(local), "_e0": F.max(index).over(local), "_n0": F.count("*").over(local),
    })
    out = d.join(edges.drop("_s", "_run"), [*keys, BUCKET, "_isl"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in before],
        F.coalesce("run_start", "_s0").alias("run_start"),
        F.coalesce("run_end", "_e0").alias("run_end"),
        F.coalesce("run_len", "_n0").alias("run_len"),
    )
