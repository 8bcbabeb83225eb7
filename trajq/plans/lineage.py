"""Cutting lineage on shared storage, so a lost executor never loses a result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast, explode, lit, pmod, sequence, struct, xxhash64


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; driver and executors must share it.

    Only a session within one machine may leave it unset: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='trajq-')}")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: What is broadcast holds at most so many rows and, by the width of their types, bytes.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20


def width(kind: T.DataType) -> int:
    """Bytes that a value of a type is reckoned with; 64 entries for an array, 16 for a map."""
    if isinstance(kind, T.StructType):
        return sum(width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 64 * width(kind.elementType)
    if isinstance(kind, T.MapType):
        return 16 * (width(kind.keyType) + width(kind.valueType))
    return 256 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def measured(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A first-pass result, computed once, and marked for broadcast only if it counts few rows.

    Two-pass operators join a summary back to all rows. Spark cannot tell the size of such a
    summary beforehand and would shuffle the whole data on its few keys; here it is written to
    the checkpoint folder and counted. Larger summaries are joined by a shuffle.
    """
    done, small = settled(df, max_rows)
    return broadcast(done) if small else done


def settled(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """The table written, and whether it is small enough to be broadcast."""
    done = checkpoint(df)
    rows = done.count()
    return done, rows <= max_rows and rows * width(done.schema) <= SMALL_BYTES


#: Parts that a key's rows are dealt into when the lookup is too large to be broadcast.
SPLITS = 32


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", *, by: Column, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join rows to a lookup with few rows per key, without gathering the rows of a key in one task.

    A lookup that counts few rows is broadcast, so the rows are not shuffled. A larger one meets them on the
    key and a part: each of the rows goes to the part that a hash of ``by`` names, the lookup's to all
    ``SPLITS`` parts. Inner and left joins.
    """
    done, small = settled(lookup, max_rows)
    if small:
        return rows.join(broadcast(done), list(keys), how)
    copied = done.withColumn("_part", explode(sequence(lit(0), lit(SPLITS - 1))))
    return rows.withColumn("_part", pmod(xxhash64(by), lit(SPLITS)).cast("int")).join(copied, [*keys, "_part"], how).drop("_part")


def single(df: DataFrame) -> Column:
    """The only row of a table as a struct (a scalar subquery), instead of a join with one row."""
    return df.select(struct(*df.columns)).scalar()
