"""Document fingerprints: every shingle hash below a fixed fraction of the hash range (a scaled sketch).

A fingerprint is ``s<scale>:<smallest hash>:<retained hashes>``. Since the fraction is fixed, the
share of a document that is kept does not depend on its length: fingerprints merge by union, and the
containment of a short document in a very long one is estimated without bias. The smallest hash
decides where neither document is long enough to keep one.

Words are runs of anything but space and the ASCII controls from tab to carriage return, A-Z as
a-z; a shingle is five words, a shorter text is one shingle. Null text counts as empty. The order of
documents is that of doc_id, null first, ties by text, so repeated rows follow each other; the last
is followed by the first. A text without words keeps nothing: it is alike only to another such.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import Words, shingles, slices

#: One hash in SCALE is retained; a power of two of at most 32.
SCALE = 4


def retained(words: np.ndarray, scale: int) -> tuple[int | None, np.ndarray]:
    """The smallest shingle hash and, ascending, 32 bits of each distinct one below the threshold."""
    h = shingles(words)
    if not len(h):
        return None, np.zeros(0, np.uint32)
    bits = np.uint64(32 - scale.bit_length() + 1)
    return int(h.min()), np.unique((h[h < np.uint64((1 << 64) // scale)] >> bits).astype(np.uint32))


def spell(sketch: tuple[int | None, np.ndarray], scale: int) -> str:
    low, kept = sketch
    return f"s{scale}:{'' if low is None else format(low, '016x')}:{base64.b64encode(kept.astype('<u4').tobytes()).decode()}"


def parse(fingerprint: str) -> tuple[int | None, np.ndarray]:
    _, low, kept = fingerprint.split(":")
    return int(low, 16) if low else None, np.frombuffer(base64.b64decode(kept), "<u4")


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: tuple[int | None, np.ndarray], b: tuple[int | None, np.ndarray]) -> float:
    """Estimated Jaccard similarity."""
    if not len(a[1]) and not len(b[1]):
        return float(a[0] == b[0])
    both = common(a[1], b[1])
    return both / (len(a[1]) + len(b[1]) - both)


def containment(a: tuple[int | None, np.ndarray], b: tuple[int | None, np.ndarray]) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a[1]):
        return 1.0 if a[0] is None or a[0] == b[0] else 0.0
    return common(a[1], b[1]) / len(a[1])


def merge(a: tuple[int | None, np.ndarray], b: tuple[int | None, np.ndarray]) -> tuple[int | None, np.ndarray]:
    """The fingerprint of two documents taken together."""
    lows = [x for x in (a[0], b[0]) if x is not None]
    return min(lows, default=None), np.union1d(a[1], b[1])


def sketches(words: Words, texts: list[str], scale: int) -> list[tuple[int | None, np.ndarray]]:
    hashes, bounds = words.of_texts([t.encode() for t in texts])
    return [retained(hashes[a:b], scale) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, key, doc_id, text) sorted by these within partitions of doc_id ranges.

    A bucket ends with its tail: the row or rows that come first in the next bucket. What the driver
    sees is one doc_id per bucket, and there are as many buckets as shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("c")).first()["c"] or []
    bounds = np.unique(np.array(cuts[: n - 1], np.int64))

    def bucket_of(key: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32)

    bucket = F.pandas_udf(lambda key: pd.Series(bucket_of(key)), "int")
    firsts = sorted((r["key"], r["bucket"]) for r in rows.select("key").withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = {key: firsts[i - 1][1] for i, (key, _) in enumerate(firsts)}
    heads, goes = np.array([k for k, _ in firsts], np.int64), np.array([before[k] for k, _ in firsts], np.int32)

    @F.pandas_udf("array<int>")
    def targets(key: pd.Series) -> pd.Series:
        own, keys = bucket_of(key), key.to_numpy()
        at = np.minimum(np.searchsorted(heads, keys), len(heads) - 1)
        return pd.Series([[b, t] if first else [b] for b, t, first in zip(own.tolist(), goes[at].tolist(), (heads[at] == keys).tolist())])

    spread = rows.select("doc_id", "text", "key", F.posexplode(targets("key")).alias("tail", "bucket"))
    return spread.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "tail", "key", "text").select("bucket", "tail", "doc_id", "text")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def fingerprint_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced by the next one's head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last = None  # the row whose next is not known yet

        def finish(rows: list[tuple]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 4] + follow[: len(t) // 4] for _, t, _, follow, _ in rows]
            marks = sketches(words, edited, scale)
            cols = [
                [r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [spell(r[2], scale) for r in rows],
                [spell(m, scale) for m in marks], [likeness(r[2], m) for r, m in zip(rows, marks)], [likeness(r[2], r[4]) for r in rows], [containment(r[2], m) for r, m in zip(rows, marks)],
            ]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in COLUMNS.split(", ")])

        for batch in slices(batches):
            buckets, tails, ids, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for bucket, tail, key, text, mark in zip(buckets, tails, ids, texts, sketches(words, texts, scale)):
                if last and last[0] == bucket:
                    rows.append((*last[1:], text, mark))
                last = None if tail else (bucket, key, text, mark)
            if rows:
                yield finish(rows)

    return beside_next(docs).mapInArrow(run, COLUMNS)
