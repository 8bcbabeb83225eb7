"""Running per-dimension statistics of a stream of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.operators.stats import flat_dims


def stream_moments(vectors: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, mean of squares, min, max and std per dimension of everything seen so far.

    The state is one row per dimension, so it does not grow with the stream and needs no
    watermark; write it in ``complete`` or ``update`` mode. The sums are kept on state rows, so
    the batching of the input does not change the result.
    """
    x = F.col("x").cast("double")
    return flat_dims(vectors, list(keys), value).groupBy(*keys, "dim").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.avg(x * x).alias("mean_sq"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.stddev_pop(x).alias("std"))
