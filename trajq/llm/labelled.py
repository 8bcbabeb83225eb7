"""All labelled documents, in blocks, for fitting a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import mapped, slices, stored
from trajq.plans.lineage import measured

#: Labelled documents that one step of a fit works on, about, and the most bytes of their features.
BLOCK, BLOCK_BYTES = 4096, 64 << 20


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def training(labels: DataFrame, label: str, of: int, held: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from: a 0/1 label and a remainder other than ``held``."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    return rows.where(F.col("y").isin(0, 1) & (remainder("doc_id", of) != held))


def gathered(docs: DataFrame, rows: DataFrame, features: Callable[[list[str]], np.ndarray | list], size: int = BLOCK) -> DataFrame:
    """block, doc_id, y, lang and x, the features as bytes, of every labelled document. Stored, block by block.

    Blocks of about ``size`` documents are dealt by a hash, so their rows do not depend on how tables or tasks are
    cut. A doc_id that stands in several rows gives several rows. Few labels are broadcast; more meet the
    documents by a shuffle.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [np.ascontiguousarray(x).tobytes() for x in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "y", "lang", "x"])

    ids = measured(rows)
    n = max(1, -(-ids.count() // size))
    found = mapped(texts.join(ids, "doc_id").select("doc_id", "text", "lang", "y"), run, "doc_id long, y int, lang string, x binary")
    found = found.select(F.pmod(F.xxhash64("doc_id", "x"), F.lit(n)).alias("block"), "*")
    return stored(found.repartition(n, "block").sortWithinPartitions("block", "doc_id", "y", "x"), "labelled")


def classes(rows: DataFrame) -> dict[int, int]:
    """Rows of each label."""
    return {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, int], list[bytes], np.ndarray]]:
    """((block, part), features, labels) of the gathered rows; a block of more than ``most`` bytes comes in parts."""
    now, part, size, x, y = None, 0, 0, [], []
    for batch in batches:
        for block, label, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "y", "x"))):
            if x and (block != now or size + len(raw) > most):
                yield (now, part), x, np.array(y, np.int64)
                part, size, x, y = part + 1, 0, [], []
            if block != now:
                now, part = block, 0
            size += len(raw)
            x.append(raw)
            y.append(label)
    if x:
        yield (now, part), x, np.array(y, np.int64)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """doc_id, a score per whole text (null as empty)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return mapped(texts, run, "doc_id long, score double")


def graded(scores: DataFrame, of: int, held: int) -> DataFrame:
    """The columns of a digest: doc_id, held_out, score, predicted."""
    return scores.select("doc_id", F.coalesce(remainder("doc_id", of) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
