"""Shuffled shards by a two-pass external shuffle.

First pass: a record's shard follows from its doc_id and the number of shards (a jump hash, so one
more shard takes records only into itself), its bucket within the shard from a seeded hash; there are
as many buckets as keep one in memory. Second pass: each task holds one bucket, orders it by content
(so a repeated task gives the same result), shuffles it by Fisher-Yates with a seed of its own and
writes it. A record's slot is its place in its shard, buckets one after another.

Null text counts as no bytes, a null doc_id as one key. Equal texts have no bearing on the shard;
rows alike in doc_id and text share a bucket. Columns named shard, bucket or position are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.llm.common import shared_folder

SHARDS, SEED = 16, 41
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 24 << 20


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys (published constants)."""
    key = keys.astype(np.uint64, copy=True)
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.float64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = np.floor((b[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[j[live] < shards]
    return b


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.xxhash64(key, F.lit(SEED)))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: int) -> np.ndarray:
    order, draws = list(range(n)), np.random.default_rng(seed).random(n)
    for i, j in zip(range(n - 1, 0, -1), (draws[1:] * np.arange(n, 1, -1)).astype(np.int64).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffle(docs: DataFrame, folder: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Write all rows, all columns, into ``folder/shard=<n>`` in shuffled order; returns them read back, with bucket and position."""
    names = [c for c in docs.columns if c not in ("shard", "bucket", "position")]
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = docs.select(*names).withColumn("shard", shard_of(key, shards))
    sums = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum(size_of(text)).alias("n")).collect()}  # a row per shard
    buckets = [max(1, -(-sums.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = np.cumsum([0, *buckets])
    start, many = (F.element_at(F.array(*map(F.lit, map(int, x))), F.col("shard") + 1) for x in (first[:-1], buckets))
    mark = F.xxhash64(key, text, F.lit(seed))
    dealt = rows.withColumn("bucket", (start + F.pmod(mark, many.cast("long"))).cast("int")).withColumn("position", mark)
    schema = dealt.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        rank = np.lexsort([table.column("position").to_numpy(), table.column("bucket").to_numpy()])
        cuts = np.flatnonzero(np.diff(table.column("bucket").to_numpy()[rank], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(rank)]):  # one bucket, unless the number of partitions was changed
            order = rank[a:b][fisher_yates(b - a, seed + int(table.column("bucket")[int(rank[a])].as_py()))]
            for at in range(0, len(order), 512):
                part = table.take(pa.array(order[at : at + 512])).combine_chunks()
                place = pa.array(np.arange(at, at + len(part)))
                yield from part.set_column(part.schema.names.index("position"), "position", place).to_batches()

    spread = dealt.repartitionById(int(first[-1]), F.col("bucket")).mapInArrow(run, schema)
    spread.sortWithinPartitions("shard", "bucket", "position").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def slots(written: DataFrame) -> DataFrame:
    """The rows with their slot in their shard; what is summed has a row per bucket."""
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = counts.select("shard", "bucket", base.alias("before"))
    return written.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("position")).drop("before")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, from the written shards."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    written = shuffle(slim, shared_folder(docs.sparkSession, "shards"), shards)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = slots(written.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), "shard", "bucket", "position"))  # no text in the join
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
