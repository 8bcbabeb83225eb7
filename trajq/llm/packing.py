"""Packing token sequences: a fixed number of open windows per partition, best fit, leftovers merged last.

Each partition tokenizes its documents and places their ids into windows of ``size`` ids. Whole
windows of a long document are cut off first; the rest goes to the open window that it fills best.
Where it fits none, the fullest window is closed - topped up with the head of the rest, since cuts
are free - and a new one is opened. What is open at the end of a partition is merged with the
leftovers of other partitions, a bounded number of windows at a time, until one pass remains.

Only ids of one document are held. Null text counts as empty (its end id remains), repeated rows are
packed each on its own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq.llm.common import SMALL_BYTES, mapped, slices, stored
from trajq.llm.tokenization import Encoder

SIZE, OPEN = 2048, 64
#: Partitions whose leftovers one task merges.
MERGED = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, closed boolean"
PIECE_ARROW = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in PIECE.split(", ")])


class Windows:
    """Open windows by the room that is left, at most ``most`` of them."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.made = size, most, 0
        self.room: list[tuple[int, int]] = []  # (room, window), ascending

    def place(self, n: int) -> tuple[int, int, int] | None:
        """Window and offset for n ids and how many of them it takes; the rest is to be placed again."""
        if n >= self.size:
            self.made += 1
            return self.made - 1, 0, self.size
        i = bisect_left(self.room, (n, -1))
        if i < len(self.room):
            room, w = self.room.pop(i)
        elif len(self.room) >= self.most:
            room, w = self.room.pop(0)  # the fullest: it takes what fills it and is closed
            return w, self.size - room, room
        else:
            room, w = self.size, self.made
            self.made += 1
        if room > n:
            insort(self.room, (room - n, w))
        return w, self.size - room, n


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """Pieces with their window in their partition; closed: the window is complete. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, windows = TaskContext.get().partitionId(), Encoder(tokenizer, end), Windows(size, most)
        waiting: dict[int, list[tuple]] = {}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "closed"]

        def batch_of(rows: list[tuple], closed: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([closed] * len(rows), pa.bool_())], names)

        for batch in slices(batches, most=SMALL_BYTES):
            done: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.ids([x or "" for x in batch.column(1).to_pylist()])):
                start, n = 0, len(ids)
                while start < n:
                    w, offset, took = windows.place(n - start)
                    row = (key, start, took, zlib.crc32(ids[start : start + took].astype("<u4").tobytes()), n, part, w, offset)
                    if offset + took == size:
                        done += [*waiting.pop(w, []), row]
                    else:
                        waiting.setdefault(w, []).append(row)
                    start += took
            yield batch_of(done, True)
        yield batch_of([r for rows in waiting.values() for r in rows], False)

    return stored(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECE), "pieces")


def merge(open_: DataFrame, size: int, most: int, last: bool) -> DataFrame:
    """Leftover windows of up to MERGED partitions joined best-fit by the tasks of their group.

    Whole windows are moved, so no piece is cut here. ``last``: nothing comes after, all are closed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, windows, at, where = None, None, None, (0, 0)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = (r["part"], r["window"])
                if r["group"] != part:
                    part, windows, at = r["group"], Windows(size, 1 << 30), None
                if key != at:
                    at, where = key, windows.place(r["used"])[:2]
                rows.append(r | {"part": part, "window": where[0], "offset": where[1] + r["offset"], "closed": last})
            yield pa.RecordBatch.from_pylist(rows, schema=PIECE_ARROW)

    used = Window.partitionBy("part", "window")
    grouped = open_.withColumn("used", F.sum("length").over(used)).withColumn("group", F.floor(F.col("part") / MERGED).cast("long"))
    ordered = grouped.repartition("group").sortWithinPartitions("group", F.desc("used"), "part", "window", "offset")
    return mapped(ordered, run, PIECE)


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, padded_length."""
    first = pieces(docs, tokenizer, end, size, most)
    spread = (first.agg(F.max("part")).first()[0] or 0) + 1
    done, open_, level = [first.where("closed").withColumn("level", F.lit(0))], first.where("not closed"), 0
    while spread > MERGED:  # groups of partitions, then groups of groups; each pass leaves fuller windows
        level, spread = level + 1, -(-spread // MERGED)
        merged = stored(merge(open_, size, most, False), "merged")
        used = Window.partitionBy("part", "window")
        merged = merged.withColumn("used", F.sum("length").over(used))
        full = F.col("used") >= size - size // 64
        done.append(merged.where(full).drop("used").withColumn("level", F.lit(level)))
        open_ = merged.where(~full).drop("used")
    done.append(merge(open_, size, most, True).withColumn("level", F.lit(level + 1)))
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    everything = stored(everything.drop("closed"), "packed")
    key = ["level", "part", "window"]
    counts = everything.groupBy("level", "part").agg(F.countDistinct("window").alias("n"))  # a row per task of the packing
    base = counts.select("level", "part", (F.sum("n").over(Window.orderBy("level", "part")) - F.col("n")).alias("base"))
    numbered = everything.groupBy(*key).agg(F.sum("length").alias("sequence_length"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("level", "part").orderBy("window")) - 1).join(base, ["level", "part"])
    sequences = numbered.select(*key, (F.col("base") + F.col("number")).alias("sequence_id"), "sequence_length")
    n = F.col("sequence_length")
    return everything.join(sequences, key).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length",
        F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(size)).alias("padded_length"),
    )
